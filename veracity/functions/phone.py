"""Phone numbers by a table of national rules: calling code, trunk prefix and national number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veracity.functions import numbering
from veracity.functions.cells import let, lookup, strip

# Names and codes of countries, and their region.
COUNTRY_REGION = {
    "INDIA": "IN", "IN": "IN", "IND": "IN", "SINGAPORE": "SG", "SG": "SG", "SGP": "SG",
    "USA": "US", "US": "US", "UNITED STATES": "US", "UNITED STATES OF AMERICA": "US",
    "UK": "GB", "UNITED KINGDOM": "GB", "GB": "GB", "GREAT BRITAIN": "GB", "AUSTRALIA": "AU", "AU": "AU", "AUS": "AU",
    "UAE": "AE", "UNITED ARAB EMIRATES": "AE", "AE": "AE", "CANADA": "CA", "CA": "CA", "CAN": "CA", "GERMANY": "DE", "DE": "DE", "DEU": "DE",
    "FRANCE": "FR", "FR": "FR", "FRA": "FR", "JAPAN": "JP", "JP": "JP", "JPN": "JP", "CHINA": "CN", "CN": "CN", "CHN": "CN",
    "BRAZIL": "BR", "BR": "BR", "BRA": "BR", "ITALY": "IT", "IT": "IT", "ITA": "IT", "SPAIN": "ES", "ES": "ES", "ESP": "ES",
    "RUSSIA": "RU", "RU": "RU", "RUS": "RU", "NETHERLANDS": "NL", "NL": "NL", "NLD": "NL", "SWITZERLAND": "CH", "CH": "CH", "CHE": "CH",
    "SWEDEN": "SE", "SE": "SE", "SWE": "SE", "NORWAY": "NO", "NO": "NO", "NOR": "NO", "DENMARK": "DK", "DK": "DK", "DNK": "DK",
    "FINLAND": "FI", "FI": "FI", "FIN": "FI", "NEW ZEALAND": "NZ", "NZ": "NZ", "NZL": "NZ", "SOUTH AFRICA": "ZA", "ZA": "ZA", "ZAF": "ZA",
    "HONG KONG": "HK", "HK": "HK", "HKG": "HK",
}
# Calling code, trunk prefix and national numbers of a region. The trunk prefix is part of the
# national form and must be written in a number without the calling code.
RULES = {
    "IN": ("91", "", "[1-9][0-9]{9}"), "US": ("1", "", "[2-9][0-9]{2}[2-9][0-9]{6}"), "SG": ("65", "", "[689][0-9]{7}"),
    "GB": ("44", "0", "(?:7[1-57-9][0-9]{8}|[12][0-9]{8,9}|[38][0-9]{9})"), "AU": ("61", "0", "[23478][0-9]{8}"), "AE": ("971", "0", "(?:5[024568][0-9]{7}|[2-4679][0-9]{7})"),
    "CA": ("1", "", "[2-9][0-9]{2}[2-9][0-9]{6}"), "DE": ("49", "0", "(?:1[5-7][0-9]{8,9}|[2-9][0-9]{5,10})"), "FR": ("33", "0", "[1-9][0-9]{8}"), "JP": ("81", "0", "[1-9][0-9]{8,9}"),
    "CN": ("86", "", "(?:1[3-9][0-9]{9}|0[1-9][0-9]{8,10})"), "BR": ("55", "", "[1-9][0-9](?:9[0-9]{8}|[2-5][0-9]{7})"), "IT": ("39", "", "(?:3[0-9]{8,9}|0[0-9]{5,10})"), "ES": ("34", "", "[5-9][0-9]{8}"),
    "RU": ("7", "8", "[3489][0-9]{9}"), "NL": ("31", "0", "[1-9][0-9]{8}"), "CH": ("41", "0", "[2-9][0-9]{8}"), "SE": ("46", "0", "[1-9][0-9]{6,8}"), "NO": ("47", "", "[2-9][0-9]{7}"),
    "DK": ("45", "", "[2-9][0-9]{7}"), "FI": ("358", "0", "[1-9][0-9]{4,10}"), "NZ": ("64", "0", "[2-9][0-9]{7,9}"), "ZA": ("27", "0", "[1-8][0-9]{8}"), "HK": ("852", "", "[2-9][0-9]{7}"),
    "AT": ("43", "0", "[1-9][0-9]{3,12}"), "BE": ("32", "0", "[1-9][0-9]{7,8}"), "IE": ("353", "0", "[1-9][0-9]{6,8}"), "SK": ("421", "0", "[2-9][0-9]{8}"), "SI": ("386", "0", "[1-7][0-9]{7}"),
    "HR": ("385", "0", "[1-9][0-9]{7,8}"), "RS": ("381", "0", "[1-9][0-9]{6,9}"), "BG": ("359", "0", "[2-9][0-9]{6,8}"), "RO": ("40", "0", "[237][0-9]{8}"), "UA": ("380", "0", "[3-9][0-9]{8}"),
    "TR": ("90", "0", "[2-5][0-9]{9}"), "EG": ("20", "0", "[1-9][0-9]{7,9}"), "IL": ("972", "0", "[2-9][0-9]{7,8}"), "TH": ("66", "0", "[2-9][0-9]{7,8}"), "VN": ("84", "0", "[2-9][0-9]{8,9}"),
    "ID": ("62", "0", "[2-9][0-9]{7,10}"), "MY": ("60", "0", "[1-9][0-9]{7,9}"), "PH": ("63", "0", "[2-9][0-9]{8,9}"), "PK": ("92", "0", "[2-9][0-9]{8,9}"), "BD": ("880", "0", "[1-9][0-9]{7,9}"),
    "LK": ("94", "0", "[1-9][0-9]{8}"), "KE": ("254", "0", "[1-9][0-9]{8}"), "NG": ("234", "0", "[1-9][0-9]{7,9}"), "GH": ("233", "0", "[235][0-9]{8}"), "TZ": ("255", "0", "[267][0-9]{8}"),
    "UG": ("256", "0", "[2-7][0-9]{8}"), "MA": ("212", "0", "[5-8][0-9]{8}"), "TW": ("886", "0", "[2-9][0-9]{7,8}"), "KR": ("82", "0", "[1-9][0-9]{7,9}"), "SA": ("966", "0", "[15][0-9]{8}"),
    "PT": ("351", "", "[2-9][0-9]{8}"), "GR": ("30", "", "[2-9][0-9]{9}"), "CZ": ("420", "", "[2-9][0-9]{8}"), "PL": ("48", "", "[1-9][0-9]{8}"), "LU": ("352", "", "[2-9][0-9]{4,10}"),
    "MT": ("356", "", "[2-9][0-9]{7}"), "CY": ("357", "", "[2-9][0-9]{7}"), "EE": ("372", "", "[3-9][0-9]{6,7}"), "LV": ("371", "", "[2-9][0-9]{7}"), "IS": ("354", "", "[4-8][0-9]{6}"),
    "MX": ("52", "", "[2-9][0-9]{9}"), "CL": ("56", "", "[2-9][0-9]{8}"), "CO": ("57", "", "[36][0-9]{9}"), "QA": ("974", "", "[3-7][0-9]{7}"), "KW": ("965", "", "[2569][0-9]{7}"),
    "BH": ("973", "", "[1367][0-9]{7}"), "OM": ("968", "", "[279][0-9]{7}"),
    "AF": ("93", "0", "[2-7][0-9]{8}"), "AL": ("355", "0", "(?:6[6-9][0-9]{7}|[2-58][0-9]{7})"), "AD": ("376", "", "[3-9][0-9]{5}"), "AM": ("374", "0", "[1-9][0-9]{7}"),
    "AO": ("244", "", "[29][0-9]{8}"), "AZ": ("994", "0", "[1-9][0-9]{8}"), "BA": ("387", "0", "[3-9][0-9]{7,8}"), "BF": ("226", "", "[025-7][0-9]{7}"),
    "BI": ("257", "", "[267][0-9]{7}"), "BN": ("673", "", "[2-578][0-9]{6}"), "BO": ("591", "", "[2-467][0-9]{7}"), "BW": ("267", "", "(?:7[1-8][0-9]{6}|[2-6][0-9]{6})"),
    "BZ": ("501", "", "[2-8][0-9]{6}"), "CD": ("243", "0", "[189][0-9]{8}"), "CF": ("236", "", "[27][0-9]{7}"), "CI": ("225", "", "[02][0-9]{9}"), "CM": ("237", "", "[26][0-9]{8}"),
    "CR": ("506", "", "[24-8][0-9]{7}"), "CV": ("238", "", "[2-59][0-9]{6}"), "DJ": ("253", "", "[27][0-9]{7}"), "DZ": ("213", "0", "(?:[5-7][0-9]{8}|[1-4][0-9]{7})"),
    "EC": ("593", "0", "(?:9[0-9]{8}|[2-7][0-9]{7})"), "ET": ("251", "0", "[1-9][0-9]{8}"), "FJ": ("679", "", "[2-9][0-9]{6}"), "FO": ("298", "", "[2-9][0-9]{5}"),
    "GI": ("350", "", "[25][0-9]{7}"), "GL": ("299", "", "[2-9][0-9]{5}"), "GM": ("220", "", "[2-9][0-9]{6}"), "GQ": ("240", "", "[2358][0-9]{8}"), "GT": ("502", "", "[2-8][0-9]{7}"),
    "GY": ("592", "", "[2-9][0-9]{6}"), "HN": ("504", "", "[237-9][0-9]{7}"), "HT": ("509", "", "[2-589][0-9]{7}"), "HU": ("36", "06", "[1-9][0-9]{7,8}"), "IQ": ("964", "0", "[1-7][0-9]{7,9}"),
    "IR": ("98", "0", "[1-9][0-9]{9}"), "JO": ("962", "0", "(?:7[0-9]{8}|[2356][0-9]{7})"), "KG": ("996", "0", "[2-9][0-9]{8}"), "KH": ("855", "0", "[1-9][0-9]{7,8}"), "KZ": ("7", "8", "[67][0-9]{9}"),
    "LA": ("856", "0", "[2-8][0-9]{7,9}"), "LI": ("423", "", "[2378][0-9]{6}"), "LS": ("266", "", "[2568][0-9]{7}"), "LY": ("218", "0", "[2-9][0-9]{7,8}"), "MD": ("373", "0", "[235-9][0-9]{7}"),
    "ME": ("382", "0", "[2-9][0-9]{7}"), "MG": ("261", "0", "[23][0-9]{8}"), "MK": ("389", "0", "[2-578][0-9]{7}"), "ML": ("223", "", "[24-9][0-9]{7}"), "MO": ("853", "", "[268][0-9]{7}"),
    "MR": ("222", "", "[2-4][0-9]{7}"), "MU": ("230", "", "(?:5[0-9]{7}|[2-9][0-9]{6})"), "MV": ("960", "", "[3-9][0-9]{6}"), "MZ": ("258", "", "(?:8[0-9]{8}|2[0-9]{7})"),
    "NA": ("264", "0", "[68][0-9]{7,8}"), "NC": ("687", "", "[2-57-9][0-9]{5}"), "NE": ("227", "", "[0289][0-9]{7}"), "NI": ("505", "", "[1257-8][0-9]{7}"), "PA": ("507", "", "(?:6[0-9]{7}|[2-9][0-9]{6})"),
    "PF": ("689", "", "[48][0-9]{7}"), "PG": ("675", "", "(?:[78][0-9]{7}|[2-9][0-9]{6})"), "PS": ("970", "0", "(?:5[0-9]{8}|[2489][0-9]{7})"), "RW": ("250", "0", "7[0-9]{8}"),
    "SC": ("248", "", "[24][0-9]{6}"), "SD": ("249", "0", "[19][0-9]{8}"), "SL": ("232", "0", "[2-9][0-9]{7}"), "SN": ("221", "", "[37][0-9]{8}"), "SR": ("597", "", "[2-8][0-9]{5,6}"),
    "SV": ("503", "", "[267][0-9]{7}"), "SY": ("963", "0", "[1-9][0-9]{7,8}"), "SZ": ("268", "", "[237][0-9]{7}"), "TD": ("235", "", "[2-9][0-9]{7}"), "TG": ("228", "", "[279][0-9]{7}"),
    "TJ": ("992", "", "[3457-9][0-9]{8}"), "TN": ("216", "", "[2-57-9][0-9]{7}"), "UZ": ("998", "", "[3-9][0-9]{8}"), "VE": ("58", "0", "[24][0-9]{9}"), "XK": ("383", "0", "[2-49][0-9]{7}"),
    "YE": ("967", "0", "[1-7][0-9]{6,8}"), "ZM": ("260", "0", "[279][0-9]{8}"),
}
# regions that use the numbers of another
RULES |= {r: RULES["US"] for r in numbering.NANP} | {r: RULES["GB"] for r in ("GG", "IM", "JE")} | {"SJ": RULES["NO"], "AX": RULES["FI"], "VA": RULES["IT"]}
#: numbers set aside for drama
SET_ASIDE = "^7700900[0-9]{3}$"
EXTENSION = r"(?i)[\s,;]*(?:extension|extn|ext|x|#|int)[.:=]?\s*([0-9]{1,7})$"
#: written by region: national form with the trunk prefix, and the form behind the calling code
HOME = {r: f"^{trunk or ('0?' if r == 'IN' else '')}({nsn})$" for r, (_, trunk, nsn) in RULES.items()}
ABROAD = {r: f"^{code}({nsn})$" for r, (code, _, nsn) in RULES.items()}
#: both, of a text without anything but digits and the + of a number that must have the calling code
WRITTEN = {r: f"^(?:{trunk or ('0?' if r == 'IN' else '')}|[+]?{code})({'(?!' + SET_ASIDE[1:] + ')' if r == 'GB' else ''}{nsn})$" for r, (code, trunk, nsn) in RULES.items()}
CODES, TRUNKS = {r: x[0] for r, x in RULES.items()}, {r: x[1] for r, x in RULES.items()}


def country_region(c: Column) -> Column:
    """Region of a country's name or code; a two-letter code with a rule stands for itself."""
    return lookup(F.upper(strip(c)), {r: r for r in RULES} | COUNTRY_REGION)


def phone_digits(c: Column) -> Column:
    """The digits of a cell as ASCII (digits of other scripts are folded)."""
    return ascii_digits(F.regexp_replace(c, r"(?U)\D", ""))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, "०१२३४५६७८९٠١٢٣٤٥٦٧٨٩", "01234567890123456789")


def subscriber_number(phone: Column, region: Column) -> Column:
    """The number without calling code, trunk prefix and extension, null when invalid.

    A number that begins with + or 00 must have the region's calling code; any other may have it.
    """
    t = strip(phone)
    # only the letters and the mark that an extension begins with are looked for in most cells
    t = F.when(t.rlike("[eExXiI#]"), F.regexp_replace(t, EXTENSION, "")).otherwise(t)
    d = ascii_digits(F.regexp_replace(F.regexp_replace(t, "^00", "+"), r"(?U)(?!^[+])\D", ""))
    return F.get(F.call_function("regexp_extract_all", d, lookup(region, WRITTEN), F.lit(1)), F.lit(0))


def national_number(phone: Column, region: Column) -> Column:
    """Digits of the national form (with the trunk prefix where the country writes one, and the extension), null when invalid."""
    t = strip(phone)
    return F.concat(lookup(region, TRUNKS), subscriber_number(phone, region), F.when(t.rlike("[eExXiI#]"), F.regexp_extract(t, EXTENSION, 1)).when(t.isNotNull(), ""))


def phone_details(phone: Column, country: Column, plan=numbering.PLAN) -> Column:
    """Struct of is_valid, region, e164, national, international and type; of a country that is not known, null.

    Type and grouping come from the numbering plan (``numbering.read_plan`` takes one from a table).  Of
    numbers that it does not hold the type is UNKNOWN and the international form has a space behind the
    calling code only.
    """
    region = country_region(country)

    def described(x: Column) -> Column:
        n, found, code = x["n"], x["found"], lookup(x["region"], CODES)
        text = lambda c: F.coalesce(F.when(n.isNotNull(), c), F.lit(""))
        return F.when(x["region"].isNotNull(), F.struct(
            n.isNotNull().alias("is_valid"), x["region"].alias("region"), text(F.concat(F.lit("+"), code, n)).alias("e164"), text(x["national"]).alias("national"),
            text(F.concat(F.lit("+"), code, F.lit(" "), numbering.grouped(n, found))).alias("international"), F.coalesce(F.get(found, F.lit(2)), F.lit("UNKNOWN")).alias("type"),
        ))

    number = F.struct(region.alias("region"), subscriber_number(phone, region).alias("n"), national_number(phone, region).alias("national"))
    return let(let(number, lambda x: F.struct(x["region"].alias("region"), x["n"].alias("n"), x["national"].alias("national"), numbering.find(x["n"], x["region"], plan).alias("found"))), described)


def phone_ok(phone: Column, country: Column) -> Column:
    """Valid, or of a country that is not known."""
    region = country_region(country)
    return region.isNull() | subscriber_number(phone, region).isNotNull()


def clean_phone(phone: Column, country: Column) -> Column:
    return F.coalesce(national_number(phone, country_region(country)), strip(phone))
