"""Rules on paths: ordered ignore rules, and policies whose strictest rule on any axis wins.

A pattern is held against each distinct path once.  Rules are a file that somebody wrote; they are sent to all tasks in blocks of
bounded size, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import stored

#: Rules that are sent to the tasks at once.
BLOCK = 20_000


def glob_regex(pattern: Column) -> Column:
    """A pattern of paths as a regular expression: * and ? stay inside a name, ** crosses names, [...] stays as it is."""
    out = F.regexp_replace(pattern, r"([.^$+(){}|\\])", r"\\$1")
    out = F.regexp_replace(out, r"\[(?![^\]]*\])", r"\\[")
    for wild, held in (("**/", "\x01"), ("**", "\x02"), ("*", "[^/]\x03"), ("?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", ".*"), ("\x03", "*")):
        out = F.replace(out, F.lit(wild), F.lit(held))
    return out


def _matches(text: Column, regex: Column) -> Column:
    return F.call_function("rlike", text, regex)


def _blocks(rules: DataFrame) -> Iterator[DataFrame]:
    """Rules in parts that are small enough to broadcast; one part if they are."""
    count = rules.count()
    for k in range(-(-count // BLOCK)):
        yield F.broadcast(rules if count <= BLOCK else rules.where(F.pmod(F.xxhash64(*rules.columns), F.lit(-(-count // BLOCK))) == k))


def _met(rows: DataFrame, rules: DataFrame, on: Column, columns: list[Column]) -> DataFrame:
    out = None
    for block in _blocks(rules):
        part = rows.join(block, on).select(*columns)
        out = part if out is None else out.union(part)
    return rows.join(rules.limit(0), on).select(*columns) if out is None else out


def parsed_ignores(lines: DataFrame) -> DataFrame:
    """(rule_no, scope, regex, negated, dir_only) of ignore lines (rule_no, scope, line): comments and blank lines are none.

    A line with a slash, but for one at its end, is bound to its folder (scope); others match at any depth below it.
    """
    text = F.rtrim(F.regexp_replace("line", "^!", ""))
    folder = text.endswith("/") & ~text.endswith("\\/")
    name = F.when(folder, F.expr("substr(t, 1, length(t) - 1)")).otherwise(F.col("t"))
    rows = lines.where(~F.col("line").startswith("#") & (text != "")).withColumn("t", text)
    rows = rows.select("rule_no", "scope", F.col("line").startswith("!").alias("negated"), (F.col("t").endswith("/") & ~F.col("t").endswith("\\/")).alias("dir_only"), name.alias("t"))
    bound = F.col("t").contains("/")
    body = glob_regex(F.regexp_replace("t", "^/", ""))
    return rows.select("rule_no", "scope", F.concat(F.when(bound, "^").otherwise("^(?:.*/)?"), body, F.lit("$")).alias("regex"), "negated", "dir_only")


def _above(path: Column) -> Column:
    """The folders around a path, from the outermost."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored, rule_no): for each distinct path whether it, or a folder around it, is ignored, and the rule that decides for the outermost such.

    rules: parsed_ignores(); for one entry the last rule that matches counts, and nothing below an ignored folder is seen again.
    A folder is judged once, however many files it holds.
    """
    files = paths.select("path").where("path IS NOT NULL").distinct()
    below = stored(files.select("path", F.posexplode(F.concat(_above(F.col("path")), F.array("path"))).alias("depth", "entry")).withColumn("is_dir", F.col("entry") != F.col("path")))
    entries = below.select("entry", "is_dir").distinct()
    scoped = entries.select("entry", "is_dir", F.explode(F.concat(F.array(F.lit("")), _above(F.col("entry")))).alias("at"))
    rest = F.when(F.col("at") == "", F.col("entry")).otherwise(F.expr("substr(entry, length(at) + 2)"))
    on = (F.col("at") == F.col("scope")) & (F.col("is_dir") | ~F.col("dir_only")) & _matches(rest, F.col("regex"))
    met = _met(scoped, rules, on, [F.col(c) for c in ("entry", "is_dir", "rule_no", "negated")])
    last = met.groupBy("entry", "is_dir").agg(F.max(F.struct("rule_no", "negated")).alias("last")).where("NOT last.negated")
    hit = below.join(last, ["entry", "is_dir"]).groupBy("path").agg(F.min(F.struct("depth", "last.rule_no")).alias("first"))
    return files.join(hit, "path", "left").select("path", F.col("first").isNotNull().alias("ignored"), F.col("first.rule_no").alias("rule_no"))


@dataclass(frozen=True)
class Policy:
    """What a policy says, by axis; levels are numbers, of which a greater one is stricter.

    paths: (no, pattern, level, never_send), of which the most specific decides (later ones of equals); path_rules: the same columns, all of which count;
    classes: (no, tag, pattern, level, never_send); languages: (no, language, level); rules: (no, pattern, level), for names of rules.
    """

    base: int
    tiers: dict[str, int]
    paths: DataFrame
    path_rules: DataFrame
    classes: DataFrame
    languages: DataFrame
    rules: DataFrame
    axes: tuple[str, ...] = field(default=("base", "provider_tier", "never_send", "settings_path", "path_rule", "classification", "language", "rule"))


def _said(policy: Policy, axis: str, no: Column, name: Column, level: Column) -> Column:
    return F.struct(
        F.lit(policy.axes.index(axis)).alias("place"), no.cast("long").alias("no"), F.lit(axis).alias("axis"), name.cast("string").alias("name"), level.cast("int").alias("level")
    ).alias("said")


def _by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("said")).alias(f"said_{key}"))


def resolved(rows: DataFrame, policy: Policy) -> DataFrame:
    """rows (path, tier, language, rule ...) with ``level``, ``never_send``, ``tags`` and ``contributions``, in the order of the axes: who said what.

    The level is the strictest that any axis asks for.  Null languages, rules and tiers ask for nothing.
    """
    nothing = F.lit(None)
    paths = stored(rows.select("path").where("path IS NOT NULL").distinct())
    fits = _matches(F.col("path"), F.concat(F.lit("^"), glob_regex(F.col("pattern")), F.lit("$")))
    segments = F.split("pattern", "/")
    special = F.struct(F.size(F.filter(segments, lambda s: ~s.rlike(r"[*?\[]"))), F.size(segments), F.col("no"))
    own = _met(paths, policy.paths, fits, [F.col(c) for c in ("path", "pattern", "no", "level", "never_send")])
    barred = own.where("never_send").select("path", _said(policy, "never_send", F.lit(0), F.lit("settings"), nothing))
    best = own.where("level IS NOT NULL").groupBy("path").agg(F.max_by("level", special).alias("level"))
    says = _met(paths, policy.path_rules, fits, [F.col("path"), F.when(F.col("never_send"), _said(policy, "never_send", F.col("no") + 1, F.concat(F.lit("path_rule"), F.col("no").cast("string")), nothing)).otherwise(_said(policy, "path_rule", F.col("no"), F.col("no"), F.col("level")))]).toDF("path", "said")
    tagged = stored(_met(paths, policy.classes, fits, [F.col(c) for c in ("path", "no", "tag", "level", "never_send")]))
    parts = [
        barred,
        best.select("path", _said(policy, "settings_path", F.lit(0), F.lit("paths"), F.col("level"))),
        says,
        tagged.where("never_send").select("path", _said(policy, "never_send", F.lit(1 << 40) + F.col("no"), F.concat(F.lit("class_"), F.col("tag")), nothing)),
        tagged.where("level IS NOT NULL").select("path", _said(policy, "classification", F.col("no"), F.col("tag"), F.col("level"))),
    ]
    said = parts[0]
    for part in parts[1:]:
        said = said.union(part)
    first = tagged.groupBy("path", "tag").agg(F.min("no").alias("no")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("no", "tag"))).alias("tags"))
    spoken = policy.languages.where("lower(language) <> 'unknown'").select(F.lower("language").alias("language"), _said(policy, "language", F.col("no"), F.lower("language"), F.col("level")))
    names = stored(rows.select("rule").where("rule IS NOT NULL").distinct())
    asked = _met(names, policy.rules, _matches(F.lower("rule"), F.concat(F.lit("^"), glob_regex(F.lower("pattern")), F.lit("$"))), [F.col("rule"), _said(policy, "rule", F.col("no"), F.col("pattern"), F.col("level"))])
    tiers = F.create_map(*(F.lit(x) for pair in policy.tiers.items() for x in pair))
    floor = F.try_element_at(tiers, F.col("tier"))
    empty = F.array().cast("array<struct<place:int,no:bigint,axis:string,name:string,level:int>>")
    out = rows.withColumn("tm_language", F.lower("language"))
    for side, key in ((_by(said, "path"), "path"), (first, "path"), (_by(spoken, "language").withColumnRenamed("language", "tm_language"), "tm_language"), (_by(asked, "rule"), "rule")):
        out = out.join(side, key, "left")
    base = F.array(_said(policy, "base", F.lit(0), F.lit(""), F.lit(policy.base)))
    tier = F.when(floor.isNotNull(), F.array(_said(policy, "provider_tier", F.lit(0), F.col("tier"), floor))).otherwise(empty)
    every = F.concat(base, tier, *(F.coalesce(f"said_{k}", empty) for k in ("path", "language", "rule")))
    whole = out.withColumn("tm_all", every)
    return whole.select(
        *(F.col(f"`{c}`") for c in rows.columns),
        F.array_max(F.transform("tm_all", lambda s: s["level"])).alias("level"),
        F.exists("tm_all", lambda s: s["axis"] == "never_send").alias("never_send"),
        F.coalesce(F.col("tags.tag"), F.array().cast("array<string>")).alias("tags"),
        F.transform("tm_all", lambda s: F.struct(s["axis"].alias("axis"), s["name"].alias("name"), s["level"].alias("level"))).alias("contributions"),
    )
