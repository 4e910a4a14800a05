"""Findings held against labelled files: matches by file, lines and weakness family, controls, and what was missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import stored

# Families of weaknesses, of which the first that has a number counts, and suffixes of source files.
FAMILIES = {
    "injection-sql": (89, 564, 943, 566),
    "injection-os": (77, 78, 88, 94, 95, 917),
    "path": (22, 23, 36, 73, 59),
    "ssrf": (918,),
    "deserialisation": (502,),
    "crypto": (326, 327, 328, 329, 330, 331, 338, 916, 759, 760),
    "authz": (284, 285, 639, 862, 863, 566),
    "xss": (79, 80, 83, 87),
    "secrets": (798, 259, 321, 312, 256, 522, 540),
    "xxe": (611, 776),
    "redirect": (601,),
    "ldap-xpath": (90, 643),
    "session": (352, 614, 1004, 330, 384),
    "trust-boundary": (501,),
    "memory": (119, 120, 121, 122, 125, 787, 415, 416, 476),
}
SUFFIXES = (".py", ".js", ".ts", ".java", ".go", ".rb", ".php", ".cs", ".c", ".cpp", ".kt")
#: Lines of a cell; findings meet the labels of three.
CELL = 8


def family(cwe: Column) -> Column:
    """The family of a weakness's number; cwe-<number> for others."""
    known: dict[int, str] = {}
    for name, members in FAMILIES.items():
        for number in members:
            known.setdefault(number, name)
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.try_element_at(names, cwe.cast("int")), F.concat(F.lit("cwe-"), cwe.cast("string")))


def _code(cwe: Column) -> Column:
    """A number for each family of family(): those without a name have their weakness's."""
    known: dict[int, int] = {}
    for at, members in enumerate(FAMILIES.values()):
        for number in members:
            known.setdefault(number, at - (1 << 31))
    codes = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.try_element_at(codes, cwe.cast("int")), cwe.cast("int"))


def _cell(line: Column) -> Column:
    return F.floor(line / CELL)


def held_against(findings: DataFrame, labels: DataFrame, window: int = 3) -> DataFrame:
    """(id, outcome, label): what each finding (id, path, start, end, cwes) is, held against labels (no, label, path, line, cwe, safe).

    A finding takes the nearest label of its file and family, ``window`` lines around, of equals the first by ``no``; line 0 stands for a whole file, at
    distance 0.  A label's first finding by path, start and id is ``matched``, others are ``duplicate``.  One without a label is ``on_control`` if the
    first safe label on its own lines is of its family (or of weakness 0), else ``false_positive`` if the labels have its family at all, else
    ``out_of_scope``, as is all outside source files.

    Labels are placed in their own cell and both beside it, so a finding meets all of its own in one, unless it is longer than two cells;
    labels of whole files are placed where findings are.  What a finding meets is summed where it met it.
    """
    source = F.lower("path").rlike("(?:" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$")
    families = F.array_distinct(F.transform(F.coalesce("cwes", F.array().cast("array<int>")), _code))
    least, most = F.col("start") - window, F.col("end") + window
    # A cell's labels are those of the one before to the one after it.
    first_cell = _cell(least) + 1
    homes = F.sequence(first_cell, F.greatest(first_cell, _cell(most)), F.lit(3).cast("long"))
    rows = findings.select("id", "path", "start", "end", families.alias("families"), F.coalesce(source, F.lit(False)).alias("source"), homes.alias("homes"))
    placed = rows.select("id", "path", "start", "end", "families", "source", F.size("homes").alias("parts"), F.explode("homes").alias("home"))
    known = labels.select("no", "label", F.col("path").alias("at_path"), "line", "cwe", _code(F.col("cwe")).alias("family"), "safe")
    lines = known.where("line <> 0").withColumn("at_home", F.explode(F.array(*(_cell(F.col("line")) + k for k in (-1, 0, 1)))))
    whole = known.where("line = 0 AND NOT safe").groupBy("at_path", "family").agg(F.min(F.struct("no", "label")).alias("w"))  # the first of a file and family is the nearest
    held = placed.where("source").select(F.col("path").alias("at_path"), F.col("home").alias("at_home")).distinct()
    whole = whole.join(held, "at_path").select("w.no", "w.label", "at_path", F.lit(0).cast(known.schema["line"].dataType).alias("line"), F.lit(None).cast(known.schema["cwe"].dataType).alias("cwe"), "family", F.lit(False).alias("safe"), "at_home")
    met = placed.join(
        lines.select(*whole.columns).union(whole),
        (F.col("path") == F.col("at_path")) & (F.col("home") == F.col("at_home")) & F.col("source")
        & F.when(F.col("safe"), F.col("line").between(F.col("start"), F.col("end"))).otherwise(((F.col("line") == 0) | F.col("line").between(least, most)) & F.array_contains("families", F.col("family"))),
        "left",
    )
    d = F.when(F.col("line") == 0, 0).otherwise(F.abs(F.col("line") - F.col("start"))).cast("int")
    sums = (
        F.min(F.when(~F.col("safe"), F.struct(d.alias("d"), "no", "label"))).alias("best"),
        F.min(F.when(F.col("safe"), F.struct("no", "label", "cwe", "family"))).alias("control"),
    )
    own = ("id", "start", "families", "source", "parts")
    found = met.groupBy("path", "home", *own).agg(*sums).drop("path", "home")
    named = F.broadcast(known.where("NOT safe").agg(F.collect_set("family").alias("named")))  # one row
    judged = found.crossJoin(named).withColumn("scoped", F.col("source") & F.coalesce(F.arrays_overlap("families", "named"), F.lit(False)))
    fits = (F.col("control.cwe") == 0) & (F.size("families") > 0) | F.array_contains("families", F.col("control.family"))
    judged = stored(judged.select("id", "start", "parts", "scoped", "best", F.col("control"), F.coalesce(fits, F.lit(False)).alias("fits")))
    long = judged.where("parts > 1").groupBy("id", "start", "parts", "scoped").agg(
        F.min("best").alias("best"), F.min("control").alias("control"), F.min_by("fits", "control").alias("fits")
    )
    each = judged.where("parts = 1").unionByName(long).select("id", "start", "scoped", "best", "control", F.coalesce("fits", F.lit(False)).alias("fits"))
    taken = each.where("best IS NOT NULL").select("id", "start", "best.no", "best.label")
    # A label's findings are of one file.
    first = taken.groupBy("no").agg(F.min(F.struct("start", "id")).alias("f")).select("no", F.col("f.id").alias("first"))
    hits = taken.join(first, "no").select("id", F.when(F.col("id") == F.col("first"), "matched").otherwise("duplicate").alias("outcome"), "label")
    outcome = F.when(F.col("fits"), "on_control").when(F.col("scoped"), "false_positive").otherwise("out_of_scope")
    return hits.union(each.where("best IS NULL").select("id", outcome, F.when(F.col("fits"), F.col("control.label"))))


def missed_labels(labels: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The labels of weaknesses that no finding took."""
    return labels.where("NOT safe").join(outcomes.where("outcome IN ('matched', 'duplicate')").select("label").distinct(), "label", "left_anti")


def rates(labels: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: matched, missed, false_positives (controls included), on_controls, duplicates, out_of_scope, precision, recall, f1; rates without a base are null."""
    count = lambda *names: F.count_if(F.col("outcome").isin(*names))
    sums = outcomes.agg(
        count("matched").alias("matched"), count("false_positive", "on_control").alias("false_positives"), count("on_control").alias("on_controls"),
        count("duplicate").alias("duplicates"), count("out_of_scope").alias("out_of_scope"),
    )
    missed = missed_labels(labels, outcomes).agg(F.count("*").alias("missed"))
    share = lambda of: F.round(F.col("matched") / F.nullif(of, F.lit(0)), 6)
    return sums.crossJoin(missed).withColumns(
        {
            "precision": share(F.col("matched") + F.col("false_positives")), "recall": share(F.col("matched") + F.col("missed")),
            "f1": F.round(2 * F.col("matched") / F.nullif(2 * F.col("matched") + F.col("false_positives") + F.col("missed"), F.lit(0)), 6),
        }
    )
