"""Numbering plans: kind and grouping of a national number by the longest prefix that the plan knows.

A plan is a table of rows (region, begins, kind, shapes).  ``begins`` lists prefixes and ranges of them
("11,20,802:806"), ``shapes`` how a number of each length is grouped ("3 3 4|3 3 3"; "*": any length, not
grouped).  Compiled, the nested prefixes of a region become disjoint sorted intervals, one list a region,
and a number is found by halving steps over its region's list inside the JVM: no join, no Python.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.functions.cells import let, lookup

#: regions that share the calling code 1, its numbers and their grouping
NANP = "US CA AG AI AS BB BM BS DM DO GD GU JM KN KY LC MP MS PR SX TC TT VC VG VI".split()
# Kinds and grouping of national numbers by their first digits.
_NANP_ROWS = """
2:9; FIXED_LINE_OR_MOBILE; 3-3-4
800,833,844,855,866,877,888; TOLL_FREE; 3-3-4
900; PREMIUM_RATE; 3-3-4
500,521:529,533,544,566,577,588; PERSONAL_NUMBER; 3-3-4
"""
_ROWS = """
AE; 5; MOBILE; 2 3 4
AE; 2:4,6,7,9; FIXED_LINE; 1 3 4
AT; 65:69; MOBILE; 3 7|3 6|3 8
AT; 1; FIXED_LINE; *
AU; 4; MOBILE; 3 3 3
AU; 2,3,7,8; FIXED_LINE; 1 4 4
BD; 13:19; MOBILE; 4-6
BE; 45:49; MOBILE; 3 2 2 2
BE; 2,3,4,9; FIXED_LINE; 1 3 2 2
BE; 1,5,6,7,8; FIXED_LINE; 2 2 2 2
BG; 87:89,98; MOBILE; 2 3 4
BG; 2; FIXED_LINE; 1 3 4
BH; 3; MOBILE; 4 4
BH; 1; FIXED_LINE; 4 4
BR; 1:9; MOBILE; 2 5-4
BR; 1:9; FIXED_LINE; 2 4-4
CH; 75:79; MOBILE; 2 3 2 2
CH; 2:6,71,81,91; FIXED_LINE; 2 3 2 2
CH; 800; TOLL_FREE; 3 3 3
CL; 9; MOBILE; 1 4 4
CL; 2; FIXED_LINE; 1 4 4
CN; 13:19; MOBILE; 3 4 4
CO; 3; MOBILE; 3 7
CO; 60; FIXED_LINE; 3 7
CY; 9; MOBILE; 2 6
CY; 2; FIXED_LINE; 2 6
CZ; 60,72,73,77,79; MOBILE; 3 3 3
CZ; 2:5; FIXED_LINE; 3 3 3
CZ; 800; TOLL_FREE; 3 3 3
DE; 15; MOBILE; 4 7
DE; 16,17; MOBILE; 3 7|3 8
DE; 2:9; FIXED_LINE; *
DE; 30,40,69,89; FIXED_LINE; 2 4|2 5|2 6|2 7|2 8|2 9
DE; 800; TOLL_FREE; 3 7
DK; 2:9; FIXED_LINE_OR_MOBILE; 2 2 2 2
DK; 80; TOLL_FREE; 2 2 2 2
DK; 90; PREMIUM_RATE; 2 2 2 2
EE; 5; MOBILE; 4 4|4 3
EE; 3,4,6,7; FIXED_LINE; 3 4
EG; 10:12,15; MOBILE; 2 8
EG; 2,3; FIXED_LINE; 1 8|1 7
ES; 6,71:74; MOBILE; 3 2 2 2
ES; 8,9; FIXED_LINE; 3 2 2 2
ES; 800,900; TOLL_FREE; 3 2 2 2
FI; 4,50; MOBILE; 2 7|2 6
FI; 9; FIXED_LINE; *
FR; 1:5; FIXED_LINE; 1 2 2 2 2
FR; 6,7; MOBILE; 1 2 2 2 2
FR; 9; VOIP; 1 2 2 2 2
FR; 800:805; TOLL_FREE; 3 2 2 2
GB; 7; MOBILE; 4 6
GB; 1; FIXED_LINE; 4 6|4 5
GB; 113:118,121,131,141,151,161,171,181,191; FIXED_LINE; 3 3 4
GB; 2; FIXED_LINE; 2 4 4
GB; 80; TOLL_FREE; 3 3 4
GB; 842:845,870:873; SHARED_COST; 3 3 4
GB; 3; UAN; 3 3 4
GH; 2,5; MOBILE; 2 3 4
GH; 3; FIXED_LINE; 2 3 4
GR; 69; MOBILE; 3 3 4
GR; 21; FIXED_LINE; 2 4 4
GR; 22:28; FIXED_LINE; 4 6
HK; 5,6,7,9; MOBILE; 4 4
HK; 2,3; FIXED_LINE; 4 4
HK; 800; TOLL_FREE; 3 3 3
HR; 9; MOBILE; 2 3 4|2 3 3
HR; 1; FIXED_LINE; 1 4 3
ID; 8; MOBILE; 3-4-4|3-4-3|3-3-3
IE; 83,85:87,89; MOBILE; 2 3 4
IE; 1; FIXED_LINE; 1 3 4
IL; 5; MOBILE; 2-3-4
IL; 2,3,4,8,9; FIXED_LINE; 1-3-4
IN; 6:9; MOBILE; 5 5
IN; 1:5; FIXED_LINE; 3 3 4
IN; 11,20,22,33,40,44,802:806; FIXED_LINE; 2 4 4
IN; 1800; TOLL_FREE; 4 2 4
IS; 6:8; MOBILE; 3 4
IS; 4,5; FIXED_LINE; 3 4
IT; 3; MOBILE; 3 3 4|3 3 3
IT; 0; FIXED_LINE; *
IT; 02,06; FIXED_LINE; 2 4 4|2 3 4
JP; 70,80,90; MOBILE; 2-4-4
JP; 50; VOIP; 2-4-4
JP; 1:9; FIXED_LINE; 2-3-4
JP; 3,6; FIXED_LINE; 1-4-4
JP; 120,800; TOLL_FREE; 3-3-3
KE; 1,7; MOBILE; 3 6
KR; 10; MOBILE; 2-4-4
KR; 2; FIXED_LINE; 1-4-4|1-3-4
KW; 5,6,9; MOBILE; 3 5
KW; 2; FIXED_LINE; 4 4
LK; 7; MOBILE; 2 3 4
LK; 1:6,8,9; FIXED_LINE; 2 3 4
LV; 2; MOBILE; 2 3 3
LV; 6; FIXED_LINE; 2 3 3
MA; 6,7; MOBILE; 3-6
MA; 5; FIXED_LINE; 3-6
MT; 77,79,99; MOBILE; 4 4
MT; 2; FIXED_LINE; 4 4
MY; 1; MOBILE; 2-3 4
MY; 11; MOBILE; 2-4 4
MY; 3; FIXED_LINE; 1-4 4
NG; 70,80,81,90,91; MOBILE; 3 3 4
NL; 6; MOBILE; 1 8
NL; 10,13,15,20,23,24,26,30,33,35,36,38,40,43,45,46,50,53,55,58,70:79; FIXED_LINE; 2 3 4
NL; 1:5; FIXED_LINE; 3 3 3
NO; 4,9; MOBILE; 3 2 3
NO; 2,3,5,6,7; FIXED_LINE; 2 2 2 2
NO; 80; TOLL_FREE; 3 2 3
NZ; 2; MOBILE; 2 3 4|2 3 3|2 4 4
NZ; 3,4,6,7,9; FIXED_LINE; 1-3 4
OM; 7,9; MOBILE; 4 4
OM; 2; FIXED_LINE; 2 6
PH; 9; MOBILE; 3 3 4
PK; 3; MOBILE; 3 7
PL; 45,50,51,53,57,60,66,69,72,73,78,79,88; MOBILE; 3 3 3
PL; 12:18,22:25,29,32:34,41:44,46,48,52,54:56,58,59,61:63,65,67,68,71,74:77,81:87,89,91,94,95; FIXED_LINE; 2 3 2 2
PL; 800; TOLL_FREE; 3 3 3
PT; 9; MOBILE; 3 3 3
PT; 2; FIXED_LINE; 3 3 3
PT; 21,22; FIXED_LINE; 2 3 4
PT; 800; TOLL_FREE; 3 3 3
QA; 3,5,6,7; MOBILE; 4 4
QA; 4; FIXED_LINE; 4 4
RO; 7; MOBILE; 3 3 3
RO; 2,3; FIXED_LINE; 3 3 3
RO; 21,31; FIXED_LINE; 2 3 4
RS; 6; MOBILE; 2 7|2 6
RU; 9; MOBILE; 3 3-2-2
RU; 3,4,8; FIXED_LINE; 3 3-2-2
RU; 800; TOLL_FREE; 3 3-2-2
SA; 5; MOBILE; 2 3 4
SA; 1; FIXED_LINE; 2 3 4
SE; 70,72,73,76,79; MOBILE; 2 3 2 2
SE; 8; FIXED_LINE; 1 3 2 2|1 3 3
SG; 8,9; MOBILE; 4 4
SG; 6; FIXED_LINE; 4 4
SK; 9; MOBILE; 3 3 3
SK; 2; FIXED_LINE; 1 3 3 2
TH; 6,8,9; MOBILE; 2 3 4
TH; 2; FIXED_LINE; 1 3 4
TR; 5; MOBILE; 3 3 2 2
TR; 2:4; FIXED_LINE; 3 3 2 2
TW; 9; MOBILE; 3 3 3
TW; 2; FIXED_LINE; 1 4 4
TZ; 6,7; MOBILE; 3 3 3
UA; 39,50,63,66:68,73,91:99; MOBILE; 2 3 4
UG; 7; MOBILE; 3 6
VN; 3,5,7,8,9; MOBILE; 2 3 2 2
ZA; 6,7,8; MOBILE; 2 3 4
ZA; 1:5; FIXED_LINE; 2 3 4
ZA; 80; TOLL_FREE; 2 3 4
"""  # fmt: skip
PLAN = [tuple(r.split("; ")) for r in _ROWS.strip().split("\n")] + [(n, *r.split("; ")) for n in NANP for r in _NANP_ROWS.strip().split("\n")]
LENGTHS = range(4, 15)


def prefixes(begins: str) -> list[str]:
    """The single prefixes of a list of prefixes and ranges."""
    out = []
    for part in begins.split(","):
        first, _, last = part.partition(":")
        if last and len(first) != len(last):
            raise ValueError(f"{part!r}: both ends of a range have the same number of digits")
        out += [str(i).zfill(len(first)) for i in range(int(first), int(last or first) + 1)]
    return out


def shapes(text: str) -> list[tuple[int, str, str]]:
    """(length, pattern of the whole number, replacement that groups it) of each shape."""
    out = []
    for shape in text.split("|"):
        if shape == "*":
            out += [(n, "(.*)", "$1") for n in LENGTHS]
        else:
            groups = [int(g) for g in re.findall("[0-9]+", shape)]
            at = iter(range(1, len(groups) + 1))
            out.append((sum(groups), "".join(f"(.{{{g}}})" for g in groups), re.sub("[0-9]+", lambda _: f"${next(at)}", shape)))
    return out


def expand(plan) -> list[tuple[str, int, str, str, str, str]]:
    """(region, length, prefix, kind, pattern, replacement); of rows alike in the first three, the first stands."""
    found = {}
    for region, begins, kind, text in plan:
        for prefix in prefixes(begins):
            for n, pattern, replacement in shapes(text):
                if n >= len(prefix):
                    found.setdefault((region, n, prefix), (kind, pattern, replacement))
    return [(*k, *v) for k, v in found.items()]


def intervals(plan) -> dict[str, list[str]]:
    """Per region, the sorted disjoint intervals as ``low~high~kind~pattern~replacement``, ends led by the length."""
    by_region: dict = {}
    for region, n, prefix, *value in expand(plan):
        pad = n - len(prefix)
        by_region.setdefault(region, []).append((int(f"1{n:02}{prefix}{'0' * pad}"), int(f"1{n:02}{prefix}{'9' * pad}"), n, tuple(value)))
    out = {}
    for region, nodes in by_region.items():
        flat, stack, at = [], [], 0

        def emit(low, high, n, value):
            if flat and flat[-1][1] + 1 == low and flat[-1][2:] == [n, value]:
                flat[-1][1] = high
            elif low <= high:
                flat.append([low, high, n, value])

        # prefixes nest or are apart, so a stack holds those around the place reached; the innermost rules
        for node in [*sorted(nodes, key=lambda x: (x[2], x[0], -x[1])), (1 << 80, 1 << 80, 99, None)]:
            while stack and (stack[-1][2] != node[2] or stack[-1][1] < node[0]):
                _, high, n, value = stack.pop()
                emit(at, high, n, value)
                at = high + 1
            if stack:
                emit(at, node[0] - 1, *stack[-1][2:])
            stack.append(node)
            at = node[0]
        out[region] = sorted("~".join([str(a)[1:], str(b)[1:], *value]) for a, b, _, value in flat)
    return out


def read_plan(table: DataFrame, most: int = 20_000) -> list[tuple]:
    """The rows of a plan table (region, begins, kind, shapes) as a plan; more than ``most`` are refused.

    A plan goes into expressions as literals, so its size is checked here; rows with nulls are refused.
    """
    rows = [tuple(r) for r in table.select("region", "begins", "kind", "shapes").distinct().orderBy("region", "begins", "shapes", "kind").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"the numbering plan has more than {most} rows")
    if any(x is None for r in rows for x in r):
        raise ValueError("the numbering plan has rows with nulls")
    return rows


@cache
def _compiled(plan: tuple) -> dict[str, list[str]]:
    return intervals(plan)


def find(number: Column, region: Column, plan=PLAN) -> Column:
    """Array (low, high, kind, pattern, replacement) of the interval that holds a national number, else null."""
    lists = _compiled(tuple(plan))
    if not lists:
        return F.lit(None).cast("array<string>")
    # regions of equal lists share one
    first: dict = {}
    shared = {r: first.setdefault(tuple(entries), r) for r, entries in lists.items()}
    table = F.create_map(*[x for entries, r in first.items() for x in (F.lit(r), F.split(F.lit("\x1e".join(entries)), "\x1e"))])
    longest = max(map(len, lists.values()))
    steps = [F.lit(1 << i) for i in reversed(range(longest.bit_length()))]
    key = F.concat(F.lpad(F.length(number).cast("string"), 2, "0"), number)

    def search(x: Column) -> Column:
        # the number of entries whose low end is not above the key
        below = F.aggregate(F.array(*steps), F.lit(0), lambda n, s: F.when(F.get(x["entries"], n + s - 1) <= F.concat(x["key"], F.lit("\x7f")), n + s).otherwise(n))
        return F.struct(x["key"].alias("key"), F.split(F.get(x["entries"], below - 1), "~").alias("found"))

    of = let(F.struct(key.alias("key"), F.element_at(table, lookup(region, shared)).alias("entries")), search)
    return let(of, lambda x: F.when(x["key"] <= F.get(x["found"], F.lit(1)), x["found"]))


def grouped(number: Column, found: Column) -> Column:
    """The number in the groups of the interval found, as it is where none was."""
    return F.coalesce(F.regexp_replace(number, F.get(found, F.lit(3)), F.get(found, F.lit(4))), number)
