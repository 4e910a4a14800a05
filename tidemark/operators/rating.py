"""Ratings of findings: likelihood and impact from threat factors and context, and the severity that a policy gives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import codes, scalars

# The default threat agent, business factors by criticality, impact factors by metric, and the table of overall risk.
THREAT = {"skill": 5, "motive": 5, "opportunity": 7, "size": 6, "discovery": 5, "exploit": 5, "awareness": 5, "detection": 8}
BUSINESS = {"low": (1, 1, 2, 3), "medium": (3, 4, 5, 5), "high": (7, 5, 5, 7), "critical": (9, 9, 7, 9)}
CONFIDENTIALITY = {"H": 7, "L": 6, "N": 0}
INTEGRITY = {"H": 7, "L": 3, "N": 0}
AVAILABILITY = {"H": 7, "L": 5, "N": 0}
ACCOUNTABILITY = {"N": 9, "L": 7, "H": 1}
OVERALL = {
    ("high", "low"): "medium", ("high", "medium"): "high", ("high", "high"): "critical",
    ("medium", "low"): "low", ("medium", "medium"): "medium", ("medium", "high"): "high",
    ("low", "low"): "note", ("low", "medium"): "low", ("low", "high"): "medium",
}
SCORE_BANDS = ((9.0, "critical"), (7.0, "high"), (4.0, "medium"), (0.1, "low"))
#: Kinds whose engine rates each instance.
ENGINE_KINDS = ("dependency", "misconfiguration", "hotspot", "secret")


def _look(key: Column, table: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def _worst(own: str, later: str) -> Column:
    """The worse of a metric of the vulnerable and the subsequent system: H, L, N; S counts as H."""
    both = F.array(F.coalesce(own, F.lit("N")), F.translate(F.coalesce(later, F.lit("N")), "S", "H"))
    return F.array_min(both)  # H < L < N as letters too


def owasp_rated(rows: DataFrame, business_known: bool = False) -> DataFrame:
    """rows with likelihood, impact, their bands and ``overall``.

    Reads entry_point, authenticated, criticality, is_test, has_path, and the metrics pr, vc, vi, va, sc, si, sa.
    """
    opportunity, size, exploit = F.lit(THREAT["opportunity"]), F.lit(THREAT["size"]), F.lit(THREAT["exploit"])
    open_network = (F.col("entry_point") == "network") & ~F.col("authenticated")
    opportunity = F.when(open_network, F.greatest(opportunity, F.lit(9))).otherwise(opportunity)
    size = F.when(open_network, F.greatest(size, F.lit(9))).otherwise(size)
    opportunity = F.when(F.col("authenticated"), F.least(opportunity, F.lit(7))).otherwise(opportunity)
    size = F.when(F.col("authenticated"), F.least(size, F.lit(6))).otherwise(size)
    local = F.col("entry_point") == "local"
    opportunity, size = (F.when(local, F.least(x, F.lit(4))).otherwise(x) for x in (opportunity, size))
    exploit = F.when(F.col("is_test"), F.greatest(exploit - 3, F.lit(0))).otherwise(exploit)
    exploit = F.when(F.col("has_path"), F.least(exploit + 1, F.lit(9))).otherwise(exploit)
    fixed = sum(THREAT[k] for k in ("skill", "motive", "discovery", "awareness", "detection"))
    likelihood = F.round((F.lit(fixed) + opportunity + size + exploit) / 8, 3)
    conf, integ, avail = _worst("vc", "sc"), _worst("vi", "si"), _worst("va", "sa")
    total = (conf == "H") & (integ == "H") & (avail == "H")
    technical = (
        F.when(total, 9).otherwise(_look(conf, CONFIDENTIALITY)) + F.when(total, 9).otherwise(_look(integ, INTEGRITY))
        + _look(avail, AVAILABILITY) + _look(F.coalesce("pr", F.lit("N")), ACCOUNTABILITY)
    ) / 4
    business = _look(F.col("criticality"), {k: sum(v) for k, v in BUSINESS.items()}) / 4
    impact = F.round(business if business_known else technical, 3)
    rated = rows.withColumns({"likelihood": likelihood, "impact": impact}).withColumns(
        {"likelihood_band": scalars.owasp_band(F.col("likelihood")), "impact_band": scalars.owasp_band(F.col("impact"))}
    )
    pairs = F.create_map(*(F.lit(x) for (i, n), v in OVERALL.items() for x in (f"{i} {n}", v)))
    return rated.withColumn("overall", F.try_element_at(pairs, F.concat_ws(" ", "impact_band", "likelihood_band")))


@dataclass(frozen=True)
class Policy:
    """How a rating becomes a severity."""

    source: str = "score"  # score, overall or strictest
    test_code_down: bool = True
    vendored_down: bool = True
    engine_floor: bool = False
    model_down: bool = False
    model_confidence: str = "high"


def _rank(name: Column) -> Column:
    return codes.severity_rank(name)


def severity_of_score(score: Column) -> Column:
    found = F.lit("info")
    for least, name in reversed(SCORE_BANDS):
        found = F.when(score >= least, name).otherwise(found)
    return found


def with_severity(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """rows with ``severity`` and ``steps``, the policy's steps in order.

    Reads score, overall, kind, engine_severity, is_test, is_vendored, model_says_vulnerable and model_confidence (nulls: unknown).
    """
    by_score = _rank(severity_of_score(F.col("score")))
    by_overall = _rank(F.when(F.col("overall") == "note", "info").otherwise(F.col("overall")))
    rank = {"score": by_score, "overall": by_overall}.get(policy.source, F.greatest(by_score, by_overall))
    engine = _rank(F.col("engine_severity"))
    own = F.col("engine_severity").isNotNull() & F.col("kind").isin(*ENGINE_KINDS)
    steps = [F.when(own, "engine_severity")]
    rank = F.when(own, engine).otherwise(rank)
    test = F.col("is_test") if policy.test_code_down else F.lit(False)
    vendored = ~test & F.col("is_vendored") if policy.vendored_down else F.lit(False)
    steps += [F.when(test, "test_code_downgrade"), F.when(vendored, "vendored_downgrade")]
    rank = F.when(test | vendored, codes.step_down(rank)).otherwise(rank)
    if policy.engine_floor:
        raised = F.coalesce(engine > rank, F.lit(False))
        steps.append(F.when(raised, "engine_floor"))
        rank = F.when(raised, engine).otherwise(rank)
    if policy.model_down:
        levels = F.array(*map(F.lit, codes.CONFIDENCES))
        sure = F.array_position(levels, F.col("model_confidence")) >= codes.CONFIDENCES.index(policy.model_confidence) + 1
        doubted = F.coalesce(~F.col("model_says_vulnerable") & sure, F.lit(False))
        steps.append(F.when(doubted, "model_downgrade"))
        rank = F.when(doubted, codes.step_down(rank)).otherwise(rank)
    return rows.withColumn("tm_rank", rank).withColumns({"steps": F.concat_ws(",", *steps), "severity": codes.severity_name(F.col("tm_rank"))}).drop("tm_rank")
