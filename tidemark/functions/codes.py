"""Names, levels, previews, paths and check characters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from least to worst, and the levels of static-analysis logs.
SEVERITIES = ("info", "low", "medium", "high", "critical")
LOG_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
CONFIDENCES = ("low", "medium", "high")
FORMULA = r"^[=+@\-\t\r]"


def _pick(names: tuple[str, ...], rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (rank + 1).cast("int"))


def severity_name(rank: Column) -> Column:
    return _pick(SEVERITIES, rank)


def severity_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), name) - 1


def step_down(rank: Column, steps: int = 1) -> Column:
    return F.greatest(rank - steps, F.lit(0))


def log_level(severity: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in LOG_LEVELS.items() for x in pair)), severity)


def matrix_label(likelihood: Column, impact: Column) -> Column:
    """The label of a five-by-five cell, by the product of its levels."""
    product = likelihood * impact
    return F.when(product <= 4, "low").when(product <= 9, "medium").when(product <= 16, "high").otherwise("critical")


def impact_level(score: Column) -> Column:
    return F.when(score <= 0, 1).when(score < 4, 2).when(score < 7, 3).when(score < 9, 4).otherwise(5)


def likelihood_level(owasp: Column, confidence: Column) -> Column:
    level = F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(owasp / 1.8).cast("int")))
    return F.when(confidence == "low", F.greatest(F.lit(1), level - 1)).otherwise(level)


def bumped(confidence: Column) -> Column:
    """One step more, where several engines agree."""
    return F.when(F.coalesce(confidence, F.lit("low")) == "low", "medium").otherwise("high")


def masked(value: Column) -> Column:
    """Two characters of a secret at most, and its length."""
    size = F.concat(F.lit(" ("), F.char_length(value).cast("string"), F.lit(" chars)"))
    return F.when(F.char_length(value) < 12, F.concat(F.lit("****"), size)).otherwise(F.concat(F.substring(value, 1, 2), F.lit("******"), size))


def token_estimate(text: Column) -> Column:
    """Seven half characters make two tokens, rounded up."""
    return F.floor((2 * F.char_length(text) + 6) / 7).cast("long")


def cut_at_word(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, ending between words where the last one is in the second half, with an ellipsis."""
    head = F.substring(text, 1, limit - 1)
    at = F.char_length(head) - F.instr(F.reverse(head), " ")  # the place of the last blank, from 0
    whole = (F.instr(head, " ") > 0) & (at > limit // 2)
    body = F.when(whole, F.substr(head, F.lit(1), at)).otherwise(head)
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(body, r"[ \t,;:.]+$", ""), F.lit("…")))


def safe_cell(value: Column) -> Column:
    """A cell that no spreadsheet reads as a formula."""
    return F.when(value.rlike(FORMULA), F.concat(F.lit("'"), value)).otherwise(value)


def comma_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def repository_path(path: Column) -> Column:
    """The path with single slashes, relative to the repository; null if it leaves it, is absolute or names no file."""
    text = F.regexp_replace(path, r"\\", "/")
    parts = F.filter(F.split(text, "/"), lambda x: ~x.isin("", "."))
    bad = (
        text.rlike(r"^/|/$|[\x00-\x1f\x7f]|^[A-Za-z]:") | F.array_contains(parts, "..") | (F.size(parts) == 0)
        | F.array_join(parts, "/").rlike("^[A-Za-z]:") | (F.char_length(F.array_join(parts, "/")) > 1024)
    )
    return F.when(~bad, F.array_join(parts, "/"))


def sub_words(name: Column) -> Column:
    """The words of an identifier: at case changes, at digits, and at what is neither."""
    marked = F.regexp_replace(name, "[^A-Za-z0-9]+", " ")
    for pattern in ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        marked = F.regexp_replace(marked, pattern, "$1 $2")
    return F.filter(F.split(marked, " +"), lambda x: x != "")


def snippet(text: Column) -> Column:
    """Lines without carriage returns and blank ones, with single blanks: the first 50."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\x0b\f]+", " ")))
    return F.array_join(F.slice(F.filter(lines, lambda x: x != ""), 1, 50), "\n")


def package_name(ecosystem: Column, name: Column) -> Column:
    """The form that a package is looked up by."""
    return (
        F.when(ecosystem == "PyPI", F.lower(F.regexp_replace(name, "[-_.]+", "-")))
        .when(ecosystem.isin("npm", "RubyGems", "Packagist", "NuGet"), F.lower(name))
        .otherwise(name)
    )


def _code(c: Column) -> Column:
    """A base-36 character's value."""
    return F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55)


def gstin_valid(value: Column) -> Column:
    """The last of 15 characters checks the others: base 36, every second one doubled."""
    products = F.transform(F.split(F.substring(value, 1, 14), ""), lambda c, i: _code(c) * F.when(i % 2 == 0, 1).otherwise(2))
    total = F.aggregate(products, F.lit(0), lambda a, p: a + F.floor(p / 36).cast("int") + p % 36)
    return F.coalesce((F.char_length(value) == 15) & (_code(F.substring(value, 15, 1)) == (36 - total % 36) % 36), F.lit(False))


def birth_date_valid(value: Column) -> Column:
    """A date of 1900 to 2100, year first, or day or month first."""
    parts = F.transform(F.split(value, r"[/.\-]"), lambda x: x.try_cast("int"))
    part = lambda i: F.get(parts, F.lit(i))

    def real(year: Column, month: Column, day: Column) -> Column:
        text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
        return year.between(1900, 2100) & F.coalesce(text.try_cast("date").isNotNull() & month.between(1, 12) & day.between(1, 31), F.lit(False))

    first = real(part(0), part(1), part(2))
    last = real(part(2), part(1), part(0)) | real(part(2), part(0), part(1))
    return F.coalesce((F.size(parts) == 3) & F.when(part(0) > 31, first).otherwise(last), F.lit(False))


# Prefixes and lengths of the card networks.
CARD_NETWORKS = (
    ("4", (13, 16, 19)),
    ("5[1-5]|2(?:2[2-9][0-9]|[3-6][0-9][0-9]|7[01][0-9]|720)", (16,)),
    ("3[47]", (15,)),
    ("6011|65|64[4-9]", (16, 17, 18, 19)),
    ("30[0-5]|3095|3[689]", (14, 15, 16, 17, 18, 19)),
    ("35(?:2[89]|[3-8][0-9])", (16, 17, 18, 19)),
    ("62", (16, 17, 18, 19)),
    ("60|65|81|82|508", (16,)),
    ("50|5[6-8]|6[0-9]", (13, 14, 15, 16, 17, 18, 19)),
)


def card_network_fits(digits: Column) -> Column:
    tests = [digits.rlike(f"^(?:{prefix})") & F.char_length(digits).isin(*sizes) for prefix, sizes in CARD_NETWORKS]
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return found


def glob_matches(value: Column, pattern: Column) -> Column:
    """Whether a value matches a pattern of * and ?, which stands in a column: all else is taken literally."""
    literal = F.regexp_replace(pattern, r"([.^$+(){}\[\]|\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.replace(F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    return F.call_function("rlike", value, regex)


def host_allowed(host: Column, allowed: list[str]) -> Column:
    """Whether a host is on the list, by itself or below a *.suffix."""
    exact = host.isin(*[a for a in allowed if not a.startswith("*.")])
    for a in allowed:
        if a.startswith("*."):
            exact = exact | host.endswith(a[1:])
    return exact
