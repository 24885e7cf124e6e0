"""Quality of detection: precision, recall, F1, confusion, reproducibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def case_match(cases: DataFrame) -> DataFrame:
    """Matched, missed and extra types of every case."""
    expected, actual = F.array_distinct("expected"), F.array_distinct("actual")
    matched = F.array_sort(F.array_intersect(expected, actual))
    missed = F.array_sort(F.array_except(expected, actual))
    extra = F.array_sort(F.array_except(actual, expected))
    return cases.select(
        "*", matched.alias("matched"), missed.alias("missed"), extra.alias("extra"),
    ).withColumn("perfect", (F.size("missed") == 0) & (F.size("extra") == 0))


def _ratio(top: Column, bottom: Column, empty: float) -> Column:
    return F.when(bottom == 0, F.lit(empty)).otherwise(F.round(top / bottom, 6))


def micro_scores(matched: DataFrame, *by: str) -> DataFrame:
    """Micro precision, recall and F1 over type assertions; with keys, `rollup` adds the total."""
    grouped = matched.rollup(*by) if by else matched.groupBy()
    sums = grouped.agg(
        F.count("*").alias("cases"),
        F.sum(F.size("matched")).alias("tp"), F.sum(F.size("extra")).alias("fp"), F.sum(F.size("missed")).alias("fn"),
        F.count_if("perfect").alias("perfect_cases"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = sums.withColumn("precision", _ratio(tp, tp + fp, 1.0)).withColumn("recall", _ratio(tp, tp + fn, 1.0))
    p, r = tp / F.nullif(tp + fp, F.lit(0)), tp / F.nullif(tp + fn, F.lit(0))
    p, r = F.coalesce(p, F.lit(1.0)), F.coalesce(r, F.lit(1.0))
    return scored.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(F.round(2 * p * r / (p + r), 6)))


def type_rollup(cases: DataFrame) -> DataFrame:
    """How often each type was expected and found."""
    def exploded(column: str) -> DataFrame:
        return cases.select(F.explode(F.array_distinct(column)).alias("type"), F.lit(column).alias("side"))

    return (
        exploded("expected").unionByName(exploded("actual")).groupBy("type").agg(
            F.count_if(F.col("side") == "expected").alias("expected_cases"),
            F.count_if(F.col("side") == "actual").alias("actual_cases"))
    )


def confusion(golden: DataFrame, predicted: DataFrame, evaluated: DataFrame) -> DataFrame:
    """File-level counts. `golden` (doc_id, positive), `predicted` (doc_id of positive files)."""
    joined = golden.filter("positive").select("doc_id", F.lit(1).alias("g")).join(
        predicted.select("doc_id").distinct().withColumn("p", F.lit(1)), "doc_id", "full_outer"
    )
    counts = joined.agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"),
        F.count_if(F.col("g").isNull()).alias("fp"),
        F.count_if(F.col("p").isNull()).alias("fn"),
        F.count("p").alias("predicted"), F.count("g").alias("actual"),
    )
    return counts.crossJoin(evaluated.agg(F.count("*").alias("evaluated"))).withColumn(
        "tn", F.greatest(F.lit(0), F.col("evaluated") - F.col("tp") - F.col("fp") - F.col("fn")))


def scenario_scores(counts: DataFrame) -> DataFrame:
    """Per family scores to three digits; null where a denominator is zero."""
    tp, fp = F.col("tp"), F.col("fp")
    precision = F.round(tp / F.nullif(tp + fp, F.lit(0)), 3)
    recall = F.round(tp / F.nullif(F.col("actual"), F.lit(0)), 3)
    scored = counts.withColumn("precision", precision).withColumn("recall", recall)
    total = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", F.round(2 * F.col("precision") * F.col("recall") / F.nullif(total, F.lit(0.0)), 3))


def completion_rate(decisions: Column, backlog: Column) -> Column:
    return F.round(decisions / F.greatest(decisions + backlog, F.lit(1)), 3)


def risk_progress(high_risk: Column, decisions: Column) -> list[Column]:
    reviewed = F.least(high_risk, decisions)
    return [
        reviewed.alias("reviewed_high_risk"),
        F.greatest(F.lit(0), high_risk - reviewed).alias("remaining_high_risk"),
        F.when(high_risk > 0, F.round(reviewed / high_risk, 3)).otherwise(1.0).alias("risk_reduction_rate"),
    ]


def safety(stages: DataFrame) -> DataFrame:
    """Whether any stage reports an unsafe act."""
    flags = ("raw_content_exposed", "legal_conclusion_provided", "deletion_executed")
    return stages.agg(*[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags])


def reproducible_share(first: DataFrame, second: DataFrame) -> DataFrame:
    """Share of documents with the same findings in two runs."""
    joined = first.withColumnRenamed("fingerprint", "a").join(second.withColumnRenamed("fingerprint", "b"), "doc_id", "full_outer")
    same = F.col("a").eqNullSafe(F.col("b"))
    return joined.agg(F.count("*").alias("documents"), F.count_if(same).alias("same"), F.round(F.avg(same.cast("double")), 6).alias("share"))


def manifest_check(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files against their manifest: present on both sides, same size, same checksum."""
    found = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("checksum"))
    joined = manifest.join(found, "path", "full_outer")
    state = (
        F.when(F.col("size").isNull(), "missing").when(F.col("byte_size").isNull(), "untracked")
        .when((F.col("size") == F.col("byte_size")) & (F.col("checksum") == F.col("sha256")), "equal").otherwise("different")
    )
    return joined.select("path", state.alias("state"))
