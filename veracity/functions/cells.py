"""Column expressions for single cells: missing values, text, numbers, e-mail and categories.

Every function takes and returns Columns and treats null as missing.  What ``let`` binds and higher-order
functions go through is interpreted; all else stays inside code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# These must equal the established rules for the same results.
NA_SENTINELS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
NULL_WORDS = ("null", "undefined", "nan")
EMPTY_WORDS = ("", "null", "nan", "none", "undefined")
ABBREVIATIONS = ("ID", "USD", "EUR", "AED", "GBP", "AUD", "UAE", "UPI", "PAYPAL", "SGD")
CURRENCIES = ("USD", "INR", "SGD", "AED", "GBP", "AUD")
CURRENCY_FORMS = {"USD": "USD", "$": "USD", "INR": "INR", "RS": "INR", "AED": "AED"}
PAYMENT_MODES = ("upi", "upi payment", "credit card", "debit card", "card", "cards", "wallet", "wallets", "e-wallet", "bank transfer", "bank_transfer", "wire", "transfer", "cod", "cash on delivery", "cash")
PAYMENT_FORMS = {"card": "Credit Card", "credit card": "Credit Card", "upi payment": "UPI", "upi": "UPI", "wire": "Bank Transfer", "bank transfer": "Bank Transfer", "cash": "COD", "cod": "COD"}
COUNTRY_FORMS = {"IN": "India", "INDIA": "India", "US": "United States", "USA": "United States", "UNITED STATES": "United States", "AE": "United Arab Emirates", "UNITED ARAB EMIRATES": "United Arab Emirates", "SG": "Singapore", "SINGAPORE": "Singapore", "UK": "United Kingdom", "UNITED KINGDOM": "United Kingdom", "AU": "Australia", "AUSTRALIA": "Australia"}
THROWAWAY_DOMAINS = ("mailinator.com", "yopmail.com", "tempmail.com", "10minutemail.com", "dispostable.com", "guerrillamail.com", "trashmail.com")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: repeating a large expression would outgrow a compiled method."""
    return F.transform(F.array(value), body)[0]


def stage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with further columns that later steps refer to by name.

    A generator of one row keeps the optimiser from copying their expressions into every later use
    and into filters pushed below, which would grow the plan with each stage.  The expressions stand in a
    projection below it: that is compiled, where a generator with one interpreted part is interpreted whole.
    """
    held = df.withColumn("_staged", F.struct(*[c.alias(k) for k, c in columns.items()]))
    # an array put together here is known to have one row: of any other a test for rows would be pushed below, with all expressions
    return held.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array("_staged")))


def listed(df: DataFrame, lists: dict[str, list[Column]], kind: str) -> DataFrame:
    """``df`` with a column of each list's items that are not null; the items are worked out before, as filtering an array is interpreted."""
    t = stage(df, {f"_all_{k}": F.array(*items).cast(f"array<{kind}>") for k, items in lists.items()})
    return stage(t, {k: F.array_compact(f"_all_{k}") for k in lists}).drop(*[f"_all_{k}" for k in lists])


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value for the key, null where it has none.

    The table is one literal that the optimiser folds to a map: a literal for each entry would take
    longer to build than most queries over small tables run.
    """
    return F.element_at(F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in table.items())), F.lit("\x1e"), F.lit("\x1f")), key)


#: characters with the property White_Space
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim all Unicode white space; only the ends of a cell are looked at, and ``c`` stands in the plan once."""
    return F.btrim(c, F.lit(WHITE))


def _blank_or(words: tuple[str, ...]) -> str:
    """A cell that is blank or one of the words in any case: most cells fail it at their first character, and nothing is trimmed."""
    return rf"\A[{WHITE}]*+(?i:{'|'.join(w for w in words if w)})?[{WHITE}]*+\z"


_MISSING, _EMPTY = _blank_or(NULL_WORDS), _blank_or(EMPTY_WORDS)


def nullify(c: Column) -> Column:
    """Null for NA sentinels, blank cells and null words; otherwise the cell as it is."""
    return F.when(c.isin(*NA_SENTINELS) | c.rlike(_MISSING), F.lit(None)).otherwise(c)


def is_missing(c: Column) -> Column:
    return F.coalesce(c.rlike(_MISSING), F.lit(True))


def is_missing_trimmed(t: Column) -> Column:
    """``is_missing`` of a cell that is trimmed already."""
    return F.coalesce(F.lower(t).isin("", *NULL_WORDS), F.lit(True))


def is_empty(c: Column) -> Column:
    """Whether a cell is null, blank or an empty word."""
    return F.coalesce(c.rlike(_EMPTY), F.lit(True))


def is_empty_row(*cols: Column) -> Column:
    """Whether every cell is blank or an empty word."""
    return reduce(Column.__and__, [is_empty(c) for c in cols], F.lit(True))


#: what a cast to double may take as a number; every text that it takes begins so
_NUMERIC = r"\A[\x00-\x20]*+[+-]?(?:[0-9]|\.[0-9]|(?i:inf|nan))[0-9a-zA-Z.+-]*+[\x00-\x20]*+\z"


def to_double(c: Column) -> Column:
    """``c`` cast to double, null where it is none; texts that can't be numbers are not tried, as each failure is an exception with its stack."""
    return F.when(c.rlike(_NUMERIC), c.try_cast("double"))


def clean_text(c: Column) -> Column:
    """One line of printable ASCII with single spaces."""
    one_line = F.regexp_replace(c, r"[\t\r\n]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(one_line, r"[^\x20-\x7E]", ""), r" +", " "))


def title_case(c: Column) -> Column:
    """Capitalise words of letters and digits, keep known abbreviations in capitals and words with an underscore as they are."""
    parts = F.regexp_extract_all(c, F.lit(r"(\w+|\W+)"), F.lit(1))
    one = lambda w: F.when(F.upper(w).isin(*ABBREVIATIONS), F.upper(w)).when(w.rlike("^[0-9A-Za-z]+$"), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))).otherwise(w)
    return F.array_join(F.transform(parts, one), "")


def clean_name(c: Column) -> Column:
    return title_case(clean_text(c))


def text_ok(c: Column) -> Column:
    """No control, format, surrogate or unassigned character but line breaks and tabs."""
    return ~F.regexp_replace(c, r"[\n\r\t]", "").rlike(r"\p{C}")


def text_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def normalize_numeric(c: Column) -> Column:
    """Without commas, leading or trailing letters, white space and currency signs."""
    mark = r"[A-Za-z$\x{20A0}-\x{20CF}\s¢£¤¥₹₨]+"
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, ",", ""), f"^{mark}", ""), f"{mark}$", "")


def to_number(c: Column) -> Column:
    """The number a cell holds once normalised, null when it holds none."""
    number = r"^[+-]?(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
    # what is no number is extracted as null: a cast that fails is an exception with its stack
    return F.replace(F.get(F.regexp_extract_all(normalize_numeric(F.when(~is_missing(c), c)), F.lit(number), F.lit(0)), F.lit(0)), F.lit("_"), F.lit("")).try_cast("double")


def email_ok(c: Column) -> Column:
    e = strip(c)
    domain = F.lower(F.substring_index(e, "@", -1))
    return F.coalesce(e.rlike(r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$") & ~e.contains("..") & ~domain.isin(*THROWAWAY_DOMAINS), F.lit(False))


def clean_email(c: Column) -> Column:
    fixed = F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    return F.when(email_ok(fixed), fixed).otherwise(c)


def clean_currency(c: Column) -> Column:
    return F.coalesce(lookup(F.upper(strip(c)), CURRENCY_FORMS), c)


def currency_ok(c: Column) -> Column:
    return F.coalesce(F.upper(strip(c)).isin(*CURRENCIES), F.lit(False))


def clean_payment(c: Column) -> Column:
    return F.coalesce(lookup(F.lower(strip(c)), PAYMENT_FORMS), c)


def payment_ok(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*PAYMENT_MODES), F.lit(False))


def clean_country(c: Column) -> Column:
    return F.coalesce(lookup(F.upper(strip(c)), COUNTRY_FORMS), c)
