"""The number guard: generated prose may carry no number that was not verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Fixed value: numbers to take out, with a sign, comparison or percent, unless part of a name.
STRIP = "(?i)[<>≤≥=~≈]?(?<![a-z0-9.])(?<![a-z][-‐–—−])[-−]?(?:[0-9]+(?:[.,·][0-9]+)*|\\.[0-9]+)%?[-‐–—−]?"


def allowed_numbers(values: Column) -> Column:
    """All numbers in the formatted verified values (array<string>)."""
    return F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: X.numbers(X.normalize(v))))


def numbers_grounded(text: Column, allowed: Column) -> Column:
    """Is every number allowed, or glued to a letter before it, as in SF-36?"""

    def check(norm: Column) -> Column:
        def fine(t: Column) -> Column:
            before = F.substring(norm, t["start"], F.lit(1))
            return ((t["start"] > 0) & before.rlike("[A-Za-z]")) | X.any_equal(allowed, t["value"])

        return F.forall(X.number_tokens(norm), fine)

    return X.let(X.normalize(text), check)


def strip_numbers(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), STRIP, " ")
    out = F.regexp_replace(out, "\\((?U:\\s*)\\)", " ")
    return X.collapse(F.regexp_replace(out, "(?U:\\s+)([,.;:)\\]])", "$1"))


def plain(text: Column) -> Column:
    """Text without any number that isn't part of a name."""
    s = X.trim(F.coalesce(text, F.lit("")))
    return F.when(numbers_grounded(s, F.array().cast("array<double>")), s).otherwise(strip_numbers(s))


def sanitize_rankings(rankings: DataFrame, values: str = "verified") -> DataFrame:
    """rankings (…, finding, finding_plain, relevance) with ``values``, the verified values of each as
    array<string>: finding as it is if grounded, else the plain one, else stripped; relevance plain."""
    finding = X.trim(F.coalesce(F.col("finding"), F.lit("")))
    kept = F.when(numbers_grounded(finding, allowed_numbers(F.col(values))), finding).otherwise(F.coalesce(X.nz(plain(F.col("finding_plain"))), strip_numbers(finding)))
    return rankings.withColumn("finding", kept).withColumn("relevance", plain(F.col("relevance"))).drop("finding_plain", values)


def attach_checks(rankings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each ranking with ``check`` (verdict, reason); unchecked without a verdict. Verdicts on unknown
    ids are dropped; of several on one id the last (seq) counts."""
    last = verdicts.groupBy("id").agg(F.max_by(F.struct("supported", "reason"), "seq").alias("v"))
    verdict = F.when(F.col("v").isNull() | F.col("v.supported").isNull(), "unchecked").when(F.col("v.supported"), "supported").otherwise("refuted")
    return rankings.join(last, "id", "left").withColumn("check", F.struct(verdict.alias("verdict"), F.coalesce(F.col("v.reason"), F.lit("")).alias("reason"))).drop("v")
