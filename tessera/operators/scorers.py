"""Scores of benchmark cases: policies, workflows, contracts and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scores import ratio


def matching(expected: Column, actual: Column) -> Column:
    """Of the expected texts those that some actual one holds."""
    return F.filter(expected, lambda e: F.exists(actual, lambda a: F.lower(a).contains(F.lower(e))))


def recall(expected: Column, actual: Column) -> Column:
    return ratio(F.size(matching(expected, actual)), F.size(expected))


def precision(selected: Column, forbidden: Column) -> Column:
    """The share of selected paths that isn't forbidden; one if nothing is selected."""
    return F.when(F.size(selected) == 0, 1.0).otherwise(F.greatest(F.size(selected) - F.size(matching(forbidden, selected)), F.lit(0)) / F.size(selected))


def quality(ranked: DataFrame, cases: DataFrame) -> DataFrame:
    """(cases, precision_at_1, hit_rate, mrr) of ranked (query, rank, path) against cases (query, expected)."""
    hits = ranked.join(cases, "query").where(F.lower("path").contains(F.lower("expected"))).groupBy("query").agg(F.min("rank").alias("first"))
    each = cases.select("query").distinct().join(hits, "query", "left")
    mean = lambda c: F.round(F.avg(c), 6)
    return each.agg(F.count("*").alias("cases"), mean(F.when(F.col("first") == 1, 1.0).otherwise(0.0)).alias("precision_at_1"), mean(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)).alias("hit_rate"), mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def policy_families(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """(family, expected, actual, true_positives, false_positives, false_negatives, precision, recall).

    cases (case_id, family, rule, source, target, expected): expected is allowed, or the outcome; findings (family, rule,
    source, target, outcome). A finding belongs to the first case of its ends, and is true if family, rule and outcome are
    the case's.
    """
    first = cases.groupBy("source", "target").agg(F.min_by(F.struct("case_id", "family", "rule", "expected"), "case_id").alias("c"))
    met = findings.join(first, ["source", "target"]).withColumn("hit", (F.col("family") == F.col("c.family")) & (F.col("rule") == F.col("c.rule")) & (F.col("outcome") == F.col("c.expected")))
    found = met.groupBy("family").agg(F.count("*").alias("actual"), F.sum(F.col("hit").cast("int")).alias("true_positives"), F.sum((~F.col("hit")).cast("int")).alias("false_positives"))
    positive = cases.where("expected <> 'allowed'")
    hit = met.where("hit").select(F.col("c.case_id").alias("case_id")).distinct().withColumn("met", F.lit(1))
    wanted = positive.join(hit, "case_id", "left").groupBy("family").agg(F.count("*").alias("expected"), F.sum(F.when(F.col("met").isNull(), 1).otherwise(0)).alias("false_negatives"))
    out = wanted.join(found, "family", "full_outer").fillna(0)
    share = lambda a, b: F.round(ratio(F.col(a), F.col(a) + F.col(b)), 6)
    return out.select("family", "expected", "actual", "true_positives", "false_positives", "false_negatives", share("true_positives", "false_positives").alias("precision"), share("true_positives", "false_negatives").alias("recall"))


def workflow(cases: DataFrame) -> DataFrame:
    """(case_id, context_recall, impact_recall, test_recall, boundary_precision, calibration_error, correct) of cases with
    arrays of expected and actual paths, forbidden ones, a probability, and expected and actual verdicts."""
    success = F.when(F.col("expected_verdict") == "fail", 0.0).otherwise(1.0)
    return cases.select(
        "case_id",
        F.round(recall(F.col("expected_context"), F.col("context")), 6).alias("context_recall"),
        F.round(recall(F.col("expected_impact"), F.col("impact")), 6).alias("impact_recall"),
        F.round(recall(F.col("expected_tests"), F.col("tests")), 6).alias("test_recall"),
        F.round(precision(F.col("boundary"), F.col("forbidden")), 6).alias("boundary_precision"),
        F.round(F.abs(F.col("probability") - success), 6).alias("calibration_error"),
        (F.col("expected_verdict") == F.col("verdict")).alias("correct"),
    )


def summary(scored: DataFrame, *by: str) -> DataFrame:
    """Means of workflow()'s columns, over all cases or by family."""
    names = ("context_recall", "impact_recall", "test_recall", "boundary_precision", "calibration_error")
    accuracy = F.coalesce(F.avg(F.col("correct").cast("double")), F.lit(1.0))
    return scored.groupBy(*by).agg(F.count("*").alias("cases"), *[F.round(F.avg(n), 6).alias(n) for n in names], F.round(accuracy, 6).alias("verdict_accuracy"))


def top_matches(ranked: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """(case_id, matched, expected, recall, passed) of the k best (case_id, rank, item) against expected (case_id, item)."""
    hits = ranked.where(F.col("rank") <= k).join(expected, ["case_id", "item"]).groupBy("case_id").agg(F.countDistinct("item").alias("matched"))
    sizes = expected.groupBy("case_id").agg(F.countDistinct("item").alias("expected")).join(hits, "case_id", "left").fillna(0)
    return sizes.select("case_id", "matched", "expected", F.round(F.col("matched") / F.col("expected"), 6).alias("recall"), (F.col("matched") == F.col("expected")).alias("passed"))


def first_is(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, rank, passed): where the expected item (case_id, item) stands among ranked (case_id, rank, item)."""
    found = ranked.join(expected, ["case_id", "item"]).groupBy("case_id").agg(F.min("rank").alias("rank"))
    return expected.select("case_id").join(found, "case_id", "left").select("case_id", "rank", F.coalesce(F.col("rank") == 1, F.lit(False)).alias("passed"))


def churn_cases(churn: DataFrame, cases: DataFrame) -> DataFrame:
    """(path, passed): whether churn (path, touches, hotspot) reaches a case's least touches and hotspot."""
    both = cases.join(churn.select("path", "touches", "hotspot"), "path", "left")
    return both.select("path", ((F.coalesce("touches", F.lit(0)) >= F.col("min_touches")) & (F.coalesce("hotspot", F.lit(0.0)) >= F.col("min_hotspot"))).alias("passed"))


def provenance_cases(first_last: DataFrame, cases: DataFrame) -> DataFrame:
    """(path, passed) of (path, first_commit, last_commit, touches) against what cases expect."""
    both = cases.join(first_last, "path", "left")
    return both.select("path", F.coalesce((F.col("first_commit") == F.col("expected_first")) & (F.col("last_commit") == F.col("expected_last")) & (F.col("touches") >= F.col("min_touches")), F.lit(False)).alias("passed"))
