"""Versions as strings that sort as the versions do, so that orders, ranges and joins are plain comparisons of columns.

A number is its digits behind their count.  A list ends with a mark that sorts before every element, and a name with one that sorts before
every character of names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

END, STOP = " ", "!"
# Ranks of pre-release names, and of qualifiers of Java packages around the release itself (5).
PRE_RELEASES = {"a": 1, "alpha": 1, "b": 2, "beta": 2, "c": 3, "rc": 3, "pre": 3, "preview": 3}
QUALIFIERS = {"alpha": 0, "a": 0, "beta": 1, "b": 1, "milestone": 2, "m": 2, "rc": 3, "cr": 3, "snapshot": 4, "ga": 5, "final": 5, "release": 5, "sp": 6}
RELEASE, OTHER = 5, 7
_EPOCH_ON = (
    r"(?i)^v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d+)?)?"
    r"((?:-(\d+))|(?:[-_.]?(?:post|rev|r)[-_.]?(\d+)?))?([-_.]?dev[-_.]?(\d+)?)?(?:\+.*)?$"
)
_PSEUDO = r"^(.*?)-?(?:0\.)?(\d{14})-[0-9a-f]{12}$"


def number(digits: Column) -> Column:
    """A string of digits, of any length; an empty one is zero."""
    bare = F.regexp_replace(digits, "^0+", "")
    shown = F.when(bare == "", "0").otherwise(bare)
    return F.concat(F.lpad(F.char_length(shown).cast("string"), 4, "0"), shown)


def _is_number(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def _part(text: Column) -> Column:
    """A number, or a name, which sorts behind numbers."""
    return F.when(_is_number(text), F.concat(F.lit("0"), number(text))).otherwise(F.concat(F.lit("1"), text, F.lit(STOP)))


def _listed(parts: Column) -> Column:
    return F.concat(F.array_join(parts, ""), F.lit(END))


def _bare(version: Column) -> Column:
    return F.regexp_replace(F.trim(version), "^[vV]+", "")


def loose_key(version: Column) -> Column:
    parts = F.filter(F.split(_bare(version), r"[.\-_+]"), lambda x: x != "")
    return _listed(F.transform(parts, lambda x: _part(F.lower(x))))


def semver_key(version: Column) -> Column:
    """Three numbers; a version with pre-release parts sorts before the one without; what follows a plus doesn't count."""
    text = F.regexp_replace(_bare(version), r"(?s)\+.*$", "")
    core, pre = F.regexp_extract(text, "^([^-]*)", 1), F.regexp_extract(text, "(?s)^[^-]*-(.*)$", 1)
    numbers = [F.coalesce(F.get(F.split(core, r"\."), F.lit(i)), F.lit("")) for i in range(3)]
    core_key = F.concat(*(number(F.when(_is_number(n), n).otherwise("")) for n in numbers))
    return F.concat(core_key, F.when(pre == "", "1").otherwise(F.concat(F.lit("0"), _listed(F.transform(F.split(pre, r"\.", -1), _part)))))


def python_key(version: Column) -> Column:
    """Epoch, release without zeros at its end, pre-release, post-release, development release.  Other texts sort before, loosely."""
    text = F.trim(version)
    group = lambda i: F.regexp_extract(text, _EPOCH_ON, i)
    release = F.regexp_replace(group(2), r"(?:\.0+)+$", "")
    pre, post, dev = F.lower(group(3)), group(5), group(8)
    rank = F.element_at(F.create_map(*(F.lit(x) for name, r in PRE_RELEASES.items() for x in (name, str(r)))), pre)
    before = F.when(pre != "", F.concat(rank, number(group(4)))).when((dev != "") & (post == ""), "0").otherwise("9")
    after = F.when(post != "", F.concat(F.lit("1"), number(F.concat(group(6), group(7))))).otherwise("0")
    last = F.when(dev != "", F.concat(F.lit("0"), number(group(9)))).otherwise("1")
    key = F.concat(F.lit("1"), number(group(1)), _listed(F.transform(F.split(release, r"\."), number)), before, after, last)
    return F.when(text.rlike(_EPOCH_ON), key).otherwise(F.concat(F.lit("0"), loose_key(version)))


def maven_key(version: Column) -> Column:
    """Numbers and qualifiers; a part that is missing counts as zero and as the release.

    Such parts before another one are only counted: behind how many of them it comes, and whether it sorts above or below them.
    """
    rank = F.map_from_arrays(F.array(*map(F.lit, QUALIFIERS)), F.array(*map(F.lit, QUALIFIERS.values())))
    parts = F.transform(
        F.regexp_extract_all(F.lower(version), F.lit("[0-9]+|[a-z]+"), 0),
        lambda x: F.struct(x.alias("x"), F.when(_is_number(x), F.lit(RELEASE)).otherwise(F.coalesce(F.try_element_at(rank, x), F.lit(OTHER))).alias("r")),
    )
    none = lambda p: (p["r"] == RELEASE) & (~_is_number(p["x"]) | p["x"].rlike("^0+$"))

    def add(state: Column, p: Column) -> Column:
        low = p["r"] < RELEASE
        place = F.when(low, F.concat(F.lit("L"), F.lpad(state["n"].cast("string"), 6, "0"))).otherwise(F.concat(F.lit("N"), F.lpad((999_999 - state["n"]).cast("string"), 6, "0")))
        shown = F.when(low, p["r"].cast("string")).when(_is_number(p["x"]), number(p["x"])).otherwise(F.concat(number(F.lit("")), F.lit("~"), p["r"].cast("string"), p["x"], F.lit(STOP)))
        key = F.concat(state["key"], place, shown)
        return F.when(none(p), F.struct((state["n"] + 1).alias("n"), state["key"].alias("key"))).otherwise(F.struct(F.lit(0).alias("n"), key.alias("key")))

    folded = F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.lit("").alias("key")), add)
    return F.concat(folded["key"], F.lit("M"))


def go_key(version: Column) -> Column:
    """Semantic versions; one made from a commit sorts behind its base by the commit's time."""
    base, time = F.regexp_extract(version, _PSEUDO, 1), F.regexp_extract(version, _PSEUDO, 2)
    of = F.when(~version.rlike(_PSEUDO), version).when(base == "", "v0.0.0").otherwise(base)
    return F.concat(semver_key(of), F.lit(END), time)


def sort_key(ecosystem: Column, version: Column) -> Column:
    """The key of a version in its ecosystem; keys of two ecosystems don't compare."""
    return (
        F.when(ecosystem == "PyPI", python_key(version))
        .when(ecosystem.isin("npm", "crates.io"), semver_key(version))
        .when(ecosystem == "Maven", maven_key(version))
        .when(ecosystem == "Go", go_key(version))
        .otherwise(loose_key(version))
    )


def compared(ecosystem: Column, a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    x, y = sort_key(ecosystem, a), sort_key(ecosystem, b)
    return (x > y).cast("int") - (x < y).cast("int")
