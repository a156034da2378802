"""Column expressions for dates and times of day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veracity.functions.cells import let, strip

_CLOCK = r"([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2})(?:\.[0-9]+)?)?"
TIME_ONLY = rf"(?i)^{_CLOCK}\s*(AM|PM)?$"
#: a time of day with hours, minutes and seconds in their bounds; one with a half-day mark and minutes and seconds in theirs; such a timestamp
_DAY_TIME = r"^([01]?[0-9]|2[0-3]):([0-5]?[0-9])(?::([0-5]?[0-9])(?:\.[0-9]+)?)?$"
_HALF_DAY = r"(?i)^(0?[0-9]|1[0-2]):([0-5]?[0-9])(?::([0-5]?[0-9])(?:\.[0-9]+)?)?\s*[AP]M$"
_STAMP = r"T((?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]|24:00:00)"
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?$"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: words and marks that may stand between the parts of a date
FILLERS = ("at", "on", "and", "ad", "of", "m", "t")


def _lexer() -> list[tuple[str, str]]:
    """Replacements that turn a written date into its parts, parted by single spaces, in lower case.

    Digits that are a whole date are cut in three; a time of day with its zone, weekdays, fillers and ordinal endings go; a month's
    name becomes ``m`` and its first three letters.
    """
    either = lambda names: "|".join(f"{n[:3]}(?:{n[3:]})?" if n[3:] else n for n in names)
    alone = lambda p: rf"(?<![A-Za-z])(?:{p})(?![A-Za-z])"
    minutes = r":[0-5]?[0-9](?::[0-5]?[0-9](?:[.,][0-9]+)?)?"
    hour, half_hour = r"(?:[01]?[0-9]|2[0-3])", r"(?:0?[0-9]|1[0-2])"
    clock = "|".join([
        rf"{half_hour}(?:{minutes})?\s*(?i:[ap]\.?m\.?)", rf"{hour}{minutes}",
        rf"{hour}\s*(?i:h|hours?)(?:\s*[0-5]?[0-9](?:\s*(?i:m|minutes?))?(?:\s*[0-5]?[0-9](?:\s*(?i:s|seconds?))?)?)?",
    ])
    zone = rf"(?:\s*(?:[Zz]|(?!(?i:{'|'.join(n[:3] for n in (*MONTHS, *WEEKDAYS))}))[A-Z]{{3,5}}))?(?:\s*[+-][0-9]{{1,2}}(?::?[0-9]{{2}})?)?"
    named = "|".join(f"({n[:3]})(?:{n[3:]})?" if n[3:] else f"({n})" for n in MONTHS).replace("(sep)(?:tember)?", "(sep)(?:t|tember)?")
    return [
        (r"^([0-9]{4})([0-9]{2})([0-9]{2})(?=[Tt\s]|$|(?:[01][0-9]|2[0-3])[0-5][0-9](?:[0-5][0-9])?$)", r"$1-$2-$3T"),
        (rf"(?:(?<=[0-9])[Tt]+\s*|[\s,]+(?:(?i:at)\s+)?|^)(?:{clock}){zone}(?=$|[\s,])", " "),
        (rf"(?<=[0-9])[Tt]+\s*(?:(?:[01][0-9]|2[0-3])(?:[0-5][0-9](?:[0-5][0-9](?:[.,][0-9]+)?)?)?{zone})?(?=$|[\s,])", " "),
        (rf"(?i)(?<=[0-9])(?:st|nd|rd|th)(?![A-Za-z])|{alone('|'.join([either(WEEKDAYS), *FILLERS]))}", " "),
        (rf"(?i){alone(named)}", " m" + "".join(f"${i}" for i in range(1, 13)) + " "),
        (r"[\s,;./'-]+", " "),
        (r"^ | $", ""),
    ]


def _resolver() -> list[tuple[str, str]]:
    """Replacements that put the parts in the order of year, month and day: ``D``, the three joined by dashes.

    The text begins with 1 where the day comes first, else with 0.  A number of more than two digits, or above 31, is the year; a
    name (its number between two ``M``) is the month.
    """
    year, short, month, big, upto12 = "([0-9]{3,4})", "([0-9]{1,2})", "M([0-9]{1,2})M", "(3[2-9]|[4-9][0-9])", "(0?[0-9]|1[0-2])"
    shapes = [
        (".", (year, month, short), "123"), (".", (year, short, month), "132"), (".", (month, year, short), "213"), (".", (month, short, year), "312"), (".", (short, month, year), "321"), (".", (short, year, month), "231"),
        (".", (month, big, short), "213"), (".", (month, short, short), "312"), (".", (big, month, short), "123"), (".", (short, month, short), "321"), (".", (short, big, month), "231"), (".", (short, short, month), "132"),
        ("1", (year, short, upto12), "132"), (".", (year, short, short), "123"), ("1", (big, short, upto12), "132"), (".", (big, short, short), "123"),
        (".", ("(1[3-9]|2[0-9]|3[01])", short, "([0-9]{1,4})"), "321"), ("1", (short, upto12, "([0-9]{1,4})"), "321"), (".", (short, short, "([0-9]{1,4})"), "312"),
    ]
    # order: which part is the year, which the month, which the day; the first shape that fits is taken, and the groups of all others are empty
    at = lambda k: "".join(f"${3 * i + int(order[k])}" for i, (_, _, order) in enumerate(shapes))
    step = (f"^(?:{'|'.join(f'{flag} ' + ' '.join(parts) for flag, parts, _ in shapes)})$", f"D{at(0)}-{at(1)}-{at(2)}")
    # two digits stand for a year from 1976 to 2075
    return [step, (r"^D([0-9])-", "D0$1-"), (r"^D([0-6][0-9]|7[0-5])-", "D20$1-"), (r"^D([0-9]{2})-", "D19$1-")]


_LEXER, _RESOLVER = _lexer(), _resolver()
#: three numbers with one mark between each, eight digits, and a full time of day behind either form: what the lexer parts without a name, word or zone to look for
PLAIN = r"^(?:([0-9]{1,4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,4})(?:[Tt](?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]+)?)?Z?)?|([0-9]{4})([0-9]{2})([0-9]{2}))$"


def parse_date(c: Column, dayfirst: Column | bool = False) -> Column:
    """The date of a cell, null when it holds none.

    A date is three parts in any of the usual orders: numbers or a month's name, parted by blanks, commas, dots, slashes or dashes or
    by nothing between digits and letters, with ordinal endings, weekday and fillers (``of``, ``at``) as they come, and a time of day
    with zone before or behind; or eight digits, with four or six more for the time.  Without a month's name, ``dayfirst`` puts the day
    before the month where the number can be a month, behind a year too; where the first number can be no month it is the day anyway.
    Two digits of a year stand for 1976 to 2075.  A cell that lacks day, month or year has no date: nothing is taken from today.

    Each step is a replacement in the text of the step before, so the expression is compiled as it stands and nothing is bound or
    computed twice.  Cells of ``PLAIN`` form skip the lexer, and those without a digit hold no date.
    """
    first = F.when(dayfirst, "1 ").otherwise("0 ") if isinstance(dayfirst, Column) else F.lit("1 " if dayfirst else "0 ")
    t = strip(c)
    lexed = t
    for pattern, by in _LEXER:
        lexed = F.regexp_replace(lexed, F.lit(pattern), F.lit(by))
    lexed = F.lower(lexed)
    for i, name in enumerate(MONTHS):
        lexed = F.replace(lexed, F.lit(f"m{name[:3]}"), F.lit(f"M{i + 1}M"))
    parts = F.when(t.rlike(PLAIN), F.regexp_replace(t, F.lit(PLAIN), F.lit("$1$4 $2$5 $3$6"))).when(t.rlike("[0-9]"), lexed)
    t = F.concat(first, parts)
    for pattern, by in _RESOLVER:
        t = F.regexp_replace(t, F.lit(pattern), F.lit(by))
    return F.regexp_extract(t, "^D((?!0+-)[0-9]+-[0-9]+-[0-9]+)$", 1).try_cast("date")


def standardize_date(c: Column, dayfirst: Column | bool = False) -> Column:
    return F.coalesce(F.date_format(parse_date(c, dayfirst), "yyyy-MM-dd"), c)


def warning_of(day: Column, c: Column, as_of: Column | str) -> Column:
    """The warning about a date that the cell ``c`` was read as."""
    today = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    return F.when(day > today, F.concat(F.lit("Future date: "), c)).when(F.year(day) < 2000, F.concat(F.lit("Date before year 2000: "), c))


def date_warning(c: Column, as_of: Column | str, dayfirst: Column | bool = False) -> Column:
    """``Future date: ...``, ``Date before year 2000: ...`` or null."""
    return let(parse_date(c, dayfirst), lambda d: warning_of(d, c, as_of))


def _two_digits(t: Column) -> Column:
    """``HH:MM:SS`` from three numbers of which each has at least two digits; further zeros before them go."""
    return F.regexp_replace(t, "^0*([0-9]{2}):0*([0-9]{2}):0*([0-9]{2})$", "$1:$2:$3")


def parse_time(c: Column) -> Column:
    """``HH:MM:SS`` of a time of day or of an ISO timestamp, null when the cell holds neither.

    A half-day mark needs an hour up to 12; hour 24 of a timestamp is midnight.  The bounds stand in the patterns,
    so that a cell takes one of three short ways and all of it is compiled.
    """
    t = strip(c)
    hour = F.regexp_extract(t, _HALF_DAY, 1).try_cast("int") % 12 + F.when(F.lower(t).endswith("pm"), 12).otherwise(0)
    half = F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), _two_digits(F.regexp_replace(t, _HALF_DAY, "00:0$2:00$3")).substr(4, 5))
    real_day = F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()
    stamp = F.when(real_day & t.rlike(_STAMP), F.regexp_replace(F.regexp_extract(t, _STAMP, 1), "^24", "00"))
    return F.when(t.rlike(_DAY_TIME), _two_digits(F.regexp_replace(t, _DAY_TIME, "0$1:0$2:00$3"))).when(t.rlike(_HALF_DAY), half).when(t.rlike(ISO), stamp)


def standardize_time(c: Column) -> Column:
    return F.coalesce(parse_time(c), F.lit("ERROR"))


#: in the order in which they are looked for
SEPARATORS = ("-", "/", ".")


def date_separator(c: Column) -> Column:
    """What parts a cell in three, null where nothing does."""
    t = strip(c)
    first = F.when(t.contains("-"), "-").when(t.contains("/"), "/").when(t.contains("."), ".")
    return F.when(F.length(t) - F.length(F.replace(t, first, F.lit(""))) == 2, first)


_THREE = r"^([0-9]+)([-/.])([0-9]+)\2([0-9]+)$"


def date_vote(c: Column) -> Column:
    """Which order a three-part date speaks for: yyyy, dd, mm or ambiguous; null where it casts no vote."""
    t = strip(c)
    n = lambda group: F.regexp_extract(t, _THREE, group).try_cast("int")
    last = F.when((n(1) > 12) & (n(3) <= 12), "dd").when((n(1) <= 12) & (n(3) > 12), "mm").otherwise("ambiguous")
    return F.when(t.rlike(_THREE), F.when(t.rlike("^[0-9]{4}[-/.]") | (n(1) > 31), "yyyy").when(t.rlike("[-/.][0-9]{4}$") | (n(4) > 31), last).otherwise("ambiguous"))


def decide_date_format(votes: dict[str, int], separator: str = "-") -> tuple[bool | None, str, float]:
    """(dayfirst, label, confidence) from the number of votes of each kind."""
    if not sum(votes.values()):
        return None, "unknown", 0.0
    clear = {k: votes.get(k, 0) for k in ("yyyy", "dd", "mm")}
    total = sum(clear.values())
    if not total:
        return None, "Mixed Formats", 50.0
    ratio = {k: v / total for k, v in clear.items()}
    best = max(ratio, key=ratio.get)
    sure = ratio[best] * 100
    sure = 95 + (sure - 90) * 0.4 if sure > 90 else sure
    label = {"yyyy": "yyyy{0}mm{0}dd", "dd": "dd{0}mm{0}yyyy", "mm": "mm{0}dd{0}yyyy"}[best].format(separator)
    if sum(r > 0.05 for r in ratio.values()) > 1:
        if ratio[best] <= 0.5:
            return None, "Mixed Formats", round(sure, 1)
        label = f"Dominant Format: {label}"
    return best == "dd", label, round(sure, 1)
