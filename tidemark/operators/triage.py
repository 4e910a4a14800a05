"""What happens to findings between scans: suppression, deltas, carried decisions, label matching, votes, chains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import codes, scalars
from tidemark.functions import text as T

#: Decisions that still hold when a finding is reported again.
CARRIED = ("confirmed", "false_positive", "accepted_risk")
GENESIS = "0" * 64


def suppressed(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, rule_no, why): findings (id, rule_id, cwe, path) that a rule covers, with the first one that does.

    rules: (rule_no, rule, rule_path, why), a file of them, so they are broadcast.  A rule is *, a rule's name, CWE-n or a
    pattern of names; its path is a pattern.
    """
    rule = F.col("rule")
    weakness = rule.rlike("^(?i)cwe-[0-9]+$")
    named = (rule == "*") | (rule == F.col("rule_id")) | (weakness & (F.substr(rule, F.lit(5)) == F.col("cwe").cast("string")))
    covers = (named | (~weakness & codes.glob_matches(F.col("rule_id"), rule))) & codes.glob_matches(F.col("path"), F.col("rule_path"))
    met = findings.select("id", "rule_id", "cwe", "path").join(F.broadcast(rules), covers)
    return met.groupBy("id").agg(F.min(F.struct("rule_no", "why")).alias("first")).select("id", "first.rule_no", "first.why")


def current_rules(rules: DataFrame, today: Column) -> DataFrame:
    """The rules of a suppressions file (rule_no, rule, rule_path, why, expires) that hold today: named, justified and not yet expired; no path is every path."""
    kept = rules.where((F.trim(F.coalesce("rule", F.lit(""))) != "") & (F.trim(F.coalesce("why", F.lit(""))) != "") & (F.col("expires").isNull() | (F.col("expires") >= today)))
    return kept.select("rule_no", F.trim("rule").alias("rule"), F.coalesce("rule_path", F.lit("**")).alias("rule_path"), F.trim("why").alias("why"))


def marked_inline(findings: DataFrame, files: DataFrame, marker: str) -> DataFrame:
    """(id, why): findings (id, rule_id, cwe, path, line) that a marker on their line, or in a comment on the line above, covers; why is null where it gives no reason.

    files: (path, text).  A marker is ``<marker>:ignore``, then rules in brackets if it isn't for all, then a dash or colon and the reason.  Only lines
    with a marker are joined.
    """
    name = marker + ":ignore"
    lines = files.where(F.col("text").contains(name)).select("path", F.posexplode(F.split("text", "\r?\n", -1)).alias("at", "source")).where(F.col("source").contains(name))
    form = rf"(?i){name}(?:\[([^\]]*)\])?\s*(?:(?:--|:|-)\s*(\S.*?))?\s*(?:\*/|-->)?\s*$"
    comment = F.ltrim("source").rlike(r"^(?:#|//|--|/\*|<!--|;)")
    marks = lines.where(F.col("source").rlike(form)).select(
        F.col("path").alias("m_path"), comment.alias("comment"), F.explode(F.array(F.struct((F.col("at") + 1).alias("on"), F.lit(0).alias("above")), F.struct((F.col("at") + 2).alias("on"), F.lit(1).alias("above")))).alias("p"),
        F.filter(F.transform(F.split(F.regexp_extract("source", form, 1), ","), lambda x: F.trim(x)), lambda x: x != "").alias("ids"), F.nullif(F.trim(F.regexp_extract("source", form, 2)), F.lit("")).alias("why"),
    )
    usable = marks.where("p.above = 0 OR comment")
    met = findings.join(usable, (F.col("path") == F.col("m_path")) & (F.col("line") == F.col("p.on")))

    def covers(rule: Column) -> Column:
        number = F.when(rule.rlike("^(?i)cwe-[0-9]+$"), F.substr(rule, F.lit(5)) == F.col("cwe").cast("string")).otherwise(codes.glob_matches(F.col("rule_id"), rule))
        return (rule == "*") | (rule == F.col("rule_id")) | number

    held = met.where((F.size("ids") == 0) | F.exists("ids", covers))
    return held.groupBy("id").agg(F.min(F.struct("p.above", "why")).alias("m")).select("id", "m.why")


def chosen(rows: DataFrame, me: str | None = None, **criteria: str | None) -> DataFrame:
    """Findings that meet all criteria that are set, worst first: severity and status (comma lists), cwe, path (a part), assignee (``me`` is oneself), q (free text).

    Free text is sought in every text column; ``F-`` and six characters name the end of an id.
    """
    wanted = {k: v for k, v in criteria.items() if v}
    known = {"severity", "status", "cwe", "path", "assignee", "q"}
    if set(wanted) - known:
        raise ValueError(f"no such criteria: {sorted(set(wanted) - known)}")
    out = rows
    for name in ("severity", "status"):
        if name in wanted:
            out = out.where(F.array_contains(codes.comma_list(F.lit(wanted[name])), F.col(name)))
    if "cwe" in wanted:
        out = out.where(F.col("cwe").cast("string") == wanted["cwe"].strip().lower().removeprefix("cwe-"))
    if "path" in wanted:
        out = out.where(F.col("path").contains(wanted["path"]))
    if "assignee" in wanted:
        out = out.where(F.col("assignee") == (me if wanted["assignee"] == "me" else wanted["assignee"]))
    if "q" in wanted:
        text = wanted["q"].lower()
        hit = F.lower(F.col("id").cast("string")).contains(text)
        for c, kind in rows.dtypes:
            if kind == "string":
                hit = hit | F.coalesce(F.lower(F.col(f"`{c}`")).contains(text), F.lit(False))
        if len(text) == 8 and text.startswith("f-"):
            hit = hit | F.lower(F.col("id").cast("string")).endswith(text[2:])
        out = out.where(hit)
    return out.orderBy(F.desc(codes.severity_rank(F.col("severity"))), "path", "line", "id") if "severity" in rows.columns else out.orderBy("path", "line", "id")


def delta_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """(fingerprint, state, old_rank, new_rank) of two scans (fingerprint, rank; new: status), a row a fingerprint in each."""
    both = old.select("fingerprint", F.col("rank").alias("old_rank"), F.lit(True).alias("was")).join(
        new.select("fingerprint", F.col("rank").alias("new_rank"), "status", F.lit(True).alias("now")), "fingerprint", "full_outer"
    )
    state = (
        F.when(F.col("was").isNull(), "new")
        .when(F.col("now").isNull() | (F.col("status") == "fixed"), "fixed")
        .when(F.col("new_rank") > F.col("old_rank"), "regressed")
        .otherwise("unchanged")
    )
    return both.select("fingerprint", state.alias("state"), "old_rank", "new_rank")


def carried(decided: DataFrame, new: DataFrame) -> DataFrame:
    """(finding, from_status, to_status, assignee): open findings of new that take over a decision or an assignee by fingerprint."""
    holds = F.col("decision").isin(*CARRIED)
    before = decided.where(holds | F.col("assignee").isNotNull())
    kept = new.where("status = 'open'").select("fingerprint", F.col("id").alias("finding")).join(before, "fingerprint")
    return kept.select("finding", F.lit("open").alias("from_status"), F.when(holds, F.col("decision")).otherwise("open").alias("to_status"), "assignee")


def matched(findings: DataFrame, labels: DataFrame, window: int) -> DataFrame:
    """(id, label, outcome): matched, duplicate or false_positive, for findings (id, path, line, cwe) and labels (label, path, line, cwe).

    Findings of one file, weakness and line share their nearest label, and of labels of one place the least counts: only distinct places meet, in cells of
    the window's width, so what meets doesn't grow with the findings and labels that stand there.
    """
    width = 2 * window + 1
    cells = F.sequence(F.floor((F.col("line") - window) / width), F.floor((F.col("line") + window) / width))
    left = findings.select("path", "cwe", "line").distinct().withColumn("cell", F.explode(cells))
    right = labels.groupBy("path", "cwe", F.col("line").alias("at")).agg(F.min("label").alias("label")).withColumn("cell", F.floor(F.col("at") / width))
    near = left.join(right, ["path", "cwe", "cell"]).where(F.abs(F.col("at") - F.col("line")) <= window)
    nearest = near.groupBy("path", "cwe", "line").agg(F.min(F.struct(F.abs(F.col("at") - F.col("line")).alias("d"), "label")).alias("b"))
    held = findings.select("id", "path", "cwe", "line").join(nearest, ["path", "cwe", "line"])
    best = held.groupBy("id").agg(F.min(F.struct("b", "path", "line")).alias("h")).select("id", "h.*")
    taken = best.select("id", "b.label", "path", "line")
    first = taken.groupBy("label").agg(F.min(F.struct("path", "line", "id")).alias("f")).select("label", F.col("f.id").alias("first"))
    named = taken.select("id", "label").join(first, "label")
    outcome = F.when(F.col("label").isNull(), "false_positive").when(F.col("first") == F.col("id"), "matched").otherwise("duplicate")
    return findings.select("id").join(named, "id", "left").select("id", "label", outcome.alias("outcome"))


def verified_chains(entries: DataFrame, key: str, order: str) -> DataFrame:
    """(key, entries, ok, first_bad, reason) of ledgers: entries (body, seq, ts, prev_hash, entry_hash), a ledger for each key.

    The first fault in a ledger counts: its own hash, its beginning, a gap in the sequence, the hash of the entry before, the time.
    """
    place = Window.partitionBy(key).orderBy(order)
    before = {c: F.lag(c).over(place) for c in ("entry_hash", "seq", "ts")}
    rows = entries.withColumns({f"before_{c}": v for c, v in before.items()})
    begins = F.col("before_seq").isNull()
    reason = (
        F.when(F.col("entry_hash") != F.sha2("body", 256), "entry hash")
        .when(begins & ((F.col("seq") != 1) | (F.col("prev_hash") != GENESIS)), "genesis")
        .when(~begins & (F.col("seq") != F.col("before_seq") + 1), "sequence")
        .when(~begins & (F.col("prev_hash") != F.col("before_entry_hash")), "previous hash")
        .when(~begins & (F.col("ts") < F.col("before_ts")), "time")
    )
    checked = rows.withColumn("reason", reason)
    bad = F.col("reason").isNotNull()
    return checked.groupBy(key).agg(
        F.count("*").alias("entries"),
        (F.count("reason") == 0).alias("ok"),
        F.min(F.when(bad, F.col("seq"))).alias("first_bad"),
        F.min_by("reason", F.when(bad, F.col(order))).alias("reason"),
    )


def page(rows: DataFrame, order: list[Column], offset: int, size: int, most: int = 1000) -> DataFrame:
    """One page of rows in order, with their number in all.  A page holds 1 to ``most`` rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(min(max(size, 1), most)).crossJoin(F.broadcast(total))


def votes(verdicts: DataFrame, key: str) -> DataFrame:
    """Verdicts (key, says, level 0 .. 2) made one a key: counts, tie, agreement, and the winners' best confidence."""
    says = F.col("says")
    counts = verdicts.groupBy(key).agg(
        F.count("*").alias("samples"),
        F.count_if(says).alias("yes"),
        F.count_if(~says).alias("no"),
        F.max(F.when(says, F.col("level"))).alias("best_yes"),
        F.max(F.when(~says, F.col("level"))).alias("best_no"),
    )
    yes, no = F.col("yes"), F.col("no")
    some, even = yes + no > 0, yes == no
    best = F.when(even, 0).when(yes > no, F.col("best_yes")).otherwise(F.col("best_no"))
    return counts.select(
        key,
        "samples",
        "yes",
        "no",
        (F.col("samples") - yes - no).alias("abstained"),
        (even & some).alias("tie"),
        F.when(some, yes >= no).alias("vulnerable"),
        F.when(~some, 0.0).when(even, 0.5).otherwise(F.round(F.greatest(yes, no) / (yes + no), 6)).alias("agreement"),
        F.when(some, F.element_at(F.array(*map(F.lit, codes.CONFIDENCES)), best + 1)).alias("confidence"),
    )


def mined_terms(docs: DataFrame, own: Column, least: int, score: float, limit: int) -> DataFrame:
    """(term, occurrences, score): words whose share among the own documents' words most exceeds that among the others'."""
    words = docs.select(own.alias("own"), F.explode(T.matches(F.lower("text"), "[a-z]+")).alias("term"))
    counts = words.groupBy("term").agg(F.count_if("own").alias("occurrences"), F.count_if(~F.col("own")).alias("outside"))
    totals = counts.agg(F.sum("occurrences").alias("own_total"), F.sum("outside").alias("other_total"))
    ratio = (F.col("occurrences") / F.col("own_total")) / (F.greatest("outside", F.lit(1)) / F.col("other_total"))
    kept = counts.where((F.char_length("term") >= 4) & (F.col("occurrences") >= least)).crossJoin(F.broadcast(totals))
    ranked = kept.select("term", "occurrences", F.round(F.ln(ratio), 6).alias("score")).where(F.col("score") >= score)
    return ranked.orderBy(F.desc("score"), F.desc("occurrences"), "term").limit(limit)


def sla(rows: DataFrame, seen: str, severity: str, days: list[int], closed: Column, now: str) -> DataFrame:
    """rows with due and state: null, overdue, due_soon (in the last fifth, a day at least) or on_track."""
    allowed = F.element_at(F.array(*map(F.lit, days)), F.col(severity))
    due = F.expr(f"`{seen}` + make_dt_interval(tm_days)")
    marked = rows.withColumn("tm_days", allowed).withColumn("due", due)
    soon = F.expr("due - make_dt_interval(greatest(1, tm_days div 5))")
    at = F.lit(now).cast("timestamp_ntz")
    state = F.when(closed, F.lit(None)).when(at > F.col("due"), "overdue").when(at > soon, "due_soon").otherwise("on_track")
    return marked.withColumn("state", state).drop("tm_days")


def number_valid(kind: Column, value: Column) -> Column:
    card = value.rlike("^[0-9]{13,19}$") & codes.card_network_fits(value) & F.coalesce(T.luhn_valid(F.regexp_extract(value, "^[0-9]+$", 0)), F.lit(False))
    return (
        F.when(kind == "iban", scalars.iban_valid(value))
        .when(kind == "gstin", codes.gstin_valid(value))
        .when(kind == "birth", codes.birth_date_valid(value))
        .when(kind == "card", card)
    )


def affected(components: DataFrame, ranges: DataFrame) -> DataFrame:
    """components (name, version) with the advisories (name, introduced, fixed) whose range holds the version; no fix is an open range."""
    numbers = lambda c: F.transform(F.split(c, r"\."), lambda x: x.cast("int"))
    met = components.join(ranges, "name").withColumns({c: numbers(F.col(c)) for c in ("version", "introduced", "fixed")})
    return met.where((F.col("version") >= F.col("introduced")) & (F.col("fixed").isNull() | (F.col("version") < F.col("fixed"))))


def correlated(findings: DataFrame, lines: int = 2) -> DataFrame:
    """(id, engines, folded): findings (id, path, line, engine, cwe, rank) that stay, with the engines that tell of them.

    Best first (highest rank, then smallest id), a finding folds on the first kept one of another engine, the same file and
    weakness, ``lines`` lines away at most.  That depends on earlier decisions, so groups are streamed; a gap of more lines
    ends a group, so a group is one stretch of a file and not the file.
    """
    order = Window.partitionBy("path", "cwe").orderBy("line", "id")
    gap = F.col("line") - F.lag("line").over(order) > lines
    cut = findings.withColumn("stretch", F.sum(F.when(gap, 1).otherwise(0)).over(order))
    rows = cut.select("path", "cwe", "stretch", "id", "line", "engine", "rank").repartition("path", "cwe", "stretch").sortWithinPartitions(
        "path", "cwe", "stretch", F.desc("rank"), "id"
    )

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A line's first kept finding, and its first of another engine, are all that others can fold on; a line's and engine's home, once found, stays.
        group, kept, places, homes = None, [], {}, {}
        for part in parts:
            done = []
            for path, cwe, stretch, ident, line, engine in zip(*(part[c].tolist() for c in ("path", "cwe", "stretch", "id", "line", "engine"))):
                if (path, cwe, stretch) != group:
                    done += kept
                    group, kept, places, homes = (path, cwe, stretch), [], {}, {}
                home = homes.get((line, engine))
                if home is None:
                    near = [k for d in range(-lines, lines + 1) for k in places.get(line + d, ()) if k[2] != engine]
                    if near:
                        home = homes[line, engine] = min(near, key=lambda k: k[1])
                if home is not None:
                    home[3].add(engine)
                    home[4] += 1
                    continue
                own, first = [ident, len(kept), engine, {engine}, 0], places.setdefault(line, [])
                if not first or (len(first) == 1 and first[0][2] != engine):
                    first.append(own)
                    kept.append(own)
                else:
                    done.append(own)
            yield _folded(done)
        yield _folded(kept)

    return rows.mapInPandas(fold, "id long, engines string, folded long")


def _folded(kept: list[list]) -> pd.DataFrame:
    return pd.DataFrame([(i, ",".join(sorted(e)), n) for i, _, _, e, n in kept], columns=["id", "engines", "folded"])
