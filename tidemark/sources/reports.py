"""Reports of analysis engines as DataFrames of findings, and findings as reports.

Readers return (engine, rule_id, level, message, path, start_line, end_line, cwe, confidence).  A report file is read whole by one task,
so writers bound the findings of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codes
from tidemark.operators.detection import numbered

_RULE = "struct<id:string,name:string,shortDescription:struct<text:string>,properties:struct<tags:array<string>>>"
_REGION = "struct<startLine:int,startColumn:int,endLine:int,endColumn:int>"
_PLACE = f"struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:{_REGION}>>"
_RESULT = (
    "struct<ruleId:string,ruleIndex:int,rule:struct<id:string,index:int>,kind:string,level:string,message:struct<text:string>,"
    f"locations:array<{_PLACE}>,partialFingerprints:map<string,string>,properties:struct<cwe:int,confidence:string>>"
)
LOG = f"version string, runs array<struct<tool:struct<driver:struct<name:string,semanticVersion:string,version:string,rules:array<{_RULE}>>>,results:array<{_RESULT}>>>"

# What each engine's own severities are called in logs.
BANDIT_LEVELS = {"HIGH": "error", "MEDIUM": "warning", "LOW": "note"}
ESLINT_LEVELS = {2: "warning", 1: "note"}
SECRET_MESSAGE = "A hard-coded secret"


def _named(key: Column, names: dict, other: str) -> Column:
    found = F.lit(other)
    for k, v in names.items():
        found = F.when(key == k, v).otherwise(found)
    return found


def read_logs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Findings of SARIF logs, a file each or (as written here) a line each; a secret's message is its rule's.

    Results that are passes, or lack a rule or a place in the repository, are left out.
    """
    logs = spark.read.schema(LOG).json(path, multiLine=not lines)
    # Results are a column of their own before they are exploded, so that no row of a result carries the run's others.
    runs = logs.select(F.explode("runs").alias("run")).select("run.tool.driver", "run.results").select("driver", F.explode("results").alias("r"))
    index = F.coalesce("r.ruleIndex", "r.rule.index")
    named = F.coalesce("r.ruleId", "r.rule.id")
    by_index = F.when(index >= 0, F.get(F.col("driver.rules"), index))
    rule = F.coalesce(by_index, F.get(F.filter("driver.rules", lambda x: x["id"] == named), F.lit(0)))
    found = runs.withColumn("rule", rule).withColumn("place", F.get(F.col("r.locations"), F.lit(0))["physicalLocation"])
    secret = F.coalesce(F.exists("rule.properties.tags", lambda t: F.lower(t).isin("secret", "secrets")), F.lit(False))
    described = F.coalesce("rule.shortDescription.text", "rule.name")
    version = F.coalesce("driver.semanticVersion", "driver.version", F.lit("unknown"))
    kept = found.where("coalesce(r.kind, 'fail') NOT IN ('pass', 'notApplicable') AND place.artifactLocation.uri IS NOT NULL")
    return kept.select(
        F.concat_ws("@", F.coalesce("driver.name", F.lit("unknown")), version).alias("engine"),
        F.coalesce(named, "rule.id").alias("rule_id"),
        F.coalesce("r.level", F.lit("warning")).alias("level"),
        F.when(secret, F.coalesce(described, F.lit(SECRET_MESSAGE))).otherwise(F.coalesce("r.message.text", described, F.lit(""))).alias("message"),
        codes.repository_path(F.col("place.artifactLocation.uri")).alias("path"),
        F.coalesce("place.region.startLine", F.lit(1)).alias("start_line"),
        F.coalesce("place.region.endLine", "place.region.startLine", F.lit(1)).alias("end_line"),
        F.col("r.properties.cwe").alias("cwe"),
        F.col("r.properties.confidence").alias("confidence"),
    ).where("rule_id IS NOT NULL AND path IS NOT NULL")


def read_bandit(spark: SparkSession, path: str) -> DataFrame:
    """Findings of Bandit's JSON reports."""
    row = "test_id:string,test_name:string,filename:string,line_number:int,line_range:array<int>,issue_severity:string,issue_confidence:string,issue_text:string,issue_cwe:struct<id:int>"
    rows = spark.read.schema(f"results array<struct<{row}>>").json(path, multiLine=True).select(F.inline("results"))
    lines = F.when(F.size("line_range") > 0, F.col("line_range")).otherwise(F.array(F.coalesce("line_number", F.lit(1))))
    title = F.concat(F.upper(F.substring("issue_text", 1, 1)), F.substr("issue_text", F.lit(2)))
    return rows.where("test_id IS NOT NULL AND filename IS NOT NULL").select(
        F.lit("bandit").alias("engine"), F.col("test_id").alias("rule_id"), _named(F.upper("issue_severity"), BANDIT_LEVELS, "warning").alias("level"),
        F.coalesce(title, F.lit("")).alias("message"), codes.repository_path(F.col("filename")).alias("path"),
        F.array_min(lines).alias("start_line"), F.array_max(lines).alias("end_line"), F.col("issue_cwe.id").alias("cwe"),
        F.lower("issue_confidence").alias("confidence"),
    )


def read_eslint(spark: SparkSession, path: str) -> DataFrame:
    """Findings of ESLint's JSON reports; messages without a rule are parse errors and left out."""
    message = "ruleId:string,severity:int,message:string,line:int,column:int,endLine:int,endColumn:int"
    rows = spark.read.schema(f"filePath string, messages array<struct<{message}>>").json(path, multiLine=True)
    found = rows.select("filePath", F.inline("messages")).where("ruleId IS NOT NULL AND ruleId <> ''")
    return found.select(
        F.lit("eslint").alias("engine"), F.col("ruleId").alias("rule_id"), _named(F.col("severity"), ESLINT_LEVELS, "warning").alias("level"),
        F.coalesce("message", F.lit("")).alias("message"), codes.repository_path(F.col("filePath")).alias("path"),
        F.coalesce("line", F.lit(1)).alias("start_line"), F.coalesce("endLine", "line", F.lit(1)).alias("end_line"),
        F.lit(None).cast("int").alias("cwe"), F.when(F.col("ruleId").startswith("security/"), "low").alias("confidence"),
    )


def write_logs(findings: DataFrame, path: str, order: list[str], most: int = 1000) -> None:
    """SARIF logs, one a line, of ``most`` results of one engine at most.

    Reads engine, rule_id, level, message, path, start_line, end_line; ``order`` orders an engine's findings totally.
    """
    placed = numbered(findings, ["engine"], order, "tm_n").withColumn("tm_log", F.floor((F.col("tm_n") - 1) / most))
    region = F.struct(F.col("start_line").cast("int").alias("startLine"), F.col("end_line").cast("int").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct("tm_n", F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    logs = placed.groupBy("engine", "tm_log").agg(F.array_sort(F.collect_list(result)).alias("results"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    rules = F.transform("rules", lambda r: F.struct(r.alias("id")))
    tool = F.struct(F.struct(F.col("engine").alias("name"), rules.alias("rules")).alias("driver"))
    results = F.transform("results", lambda r: r.dropFields("tm_n"))
    run = F.struct(tool.alias("tool"), results.alias("results"))
    logs.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs")))).write.text(path)


def write_cells(rows: DataFrame, path: str) -> None:
    """CSV files with a header in each, whose cells no spreadsheet reads as formulas; null is the empty cell."""
    cells = [codes.safe_cell(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in rows.columns]
    rows.select(*cells).write.csv(path, header=True, escape='"', emptyValue="")


def _quoted(text: Column, slash: bool = True) -> Column:
    """Percent-encoding of all but letters, digits and -._~, and of slashes where asked."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *([("%2F", "/")] if slash else [])):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


# Types of package addresses.
PACKAGE_TYPES = {"PyPI": "pypi", "npm": "npm", "Maven": "maven", "Go": "golang", "RubyGems": "gem", "Packagist": "composer", "crates.io": "cargo", "NuGet": "nuget"}


def package_url(ecosystem: Column, name: Column, version: Column) -> Column:
    """The address of a package: pkg:type/name@version."""
    first = lambda mark: F.substring_index(name, mark, 1)
    rest = lambda mark: F.substr(name, F.char_length(first(mark)) + 2)
    base = (
        F.when((ecosystem == "Maven") & name.contains(":"), F.concat(F.lit("pkg:maven/"), _quoted(first(":")), F.lit("/"), _quoted(rest(":"))))
        .when((ecosystem == "npm") & name.startswith("@"), F.concat(F.lit("pkg:npm/"), _quoted(first("/")), F.lit("/"), _quoted(rest("/"))))
        .when(ecosystem == "PyPI", F.concat(F.lit("pkg:pypi/"), _quoted(F.replace(F.lower(name), F.lit("_"), F.lit("-")))))
        .otherwise(F.concat(F.lit("pkg:"), _named(ecosystem, PACKAGE_TYPES, "generic"), F.lit("/"), _quoted(name)))
    )
    return F.when(F.coalesce(version, F.lit("")) == "", base).otherwise(F.concat(base, F.lit("@"), _quoted(version)))


def components(rows: DataFrame) -> DataFrame:
    """(app, bom): a CycloneDX 1.5 document an application, of its (ecosystem, name, version, scope, direct); equal addresses are one component."""
    address = package_url(F.col("ecosystem"), F.col("name"), F.col("version"))
    scope = F.when(F.col("scope").rlike("^(?:dev|test)"), "excluded").otherwise("required")
    flags = F.array(F.struct(F.lit("direct").alias("name"), F.col("direct").cast("string").alias("value")))
    part = F.struct(
        F.lit("library").alias("type"), F.col("purl").alias("bom-ref"), "name", F.coalesce(F.nullif("version", F.lit("")), F.lit("unspecified")).alias("version"), "purl",
        scope.alias("scope"), flags.alias("properties"),
    )
    first = rows.withColumn("purl", address).groupBy("app", "purl").agg(F.min_by(part, F.struct("name", "version", "scope", "direct")).alias("part"))
    parts = first.groupBy("app").agg(F.array_sort(F.collect_list(F.struct("purl", "part"))).alias("parts"))
    digest = F.sha2(F.array_join(F.transform("parts", lambda p: p["purl"]), ""), 256)
    serial = F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "urn:uuid:$1-$2-$3-$4-$5")
    bom = F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), serial.alias("serialNumber"), F.lit(1).alias("version"),
        F.struct(F.struct(F.lit("application").alias("type"), F.col("app").cast("string").alias("name"), F.lit("root").alias("bom-ref")).alias("component")).alias("metadata"),
        F.transform("parts", lambda p: p["part"]).alias("components"),
    )
    return parts.select("app", F.to_json(bom).alias("bom"))
