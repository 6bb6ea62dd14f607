"""The selection funnel: scores, a floor, then a limit; and a second floor after reading."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import materialize

DEFAULT_FLOOR, PRE_READ_MARGIN = 70, 20
BATCH = 30
ABSTRACT_CHARS = 3000


def as_score(raw: Column) -> Column:
    """A number, or null for null, blank and text."""
    n = X.nz(X.trim(raw.cast("string"))).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def clamp_score(raw: Column) -> Column:
    """0 to 100, rounded half up; 0 for what is no number."""
    return F.least(F.greatest(F.floor(F.coalesce(as_score(raw), F.lit(0.0)) + 0.5), F.lit(0)), F.lit(100)).cast("int")


def score_floor(raw: Column) -> Column:
    return F.when(as_score(raw).isNull(), F.lit(DEFAULT_FLOOR)).otherwise(clamp_score(raw))


def pre_read_floor(raw: Column, margin: int = PRE_READ_MARGIN) -> Column:
    return F.greatest(score_floor(raw) - margin, F.lit(0))


def batches(candidates: DataFrame, order: list[str], size: int = BATCH) -> DataFrame:
    """Candidates with ``batch``, from 0. The numbering is by rank within range partitions and offsets
    between them, so that it takes no single-task window. The partitions are written out once, so that
    ranks and offsets are of the same ones whatever is merged or run again at run time."""
    parts = materialize(candidates.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "batches")
    sizes = parts.groupBy("_p").count()
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    ranked = parts.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    return ranked.join(F.broadcast(offsets), "_p").withColumn("batch", F.floor((F.col("_before") + F.col("_n") - 1) / size)).drop("_p", "_n", "_before")


def candidate_block(abstract: Column) -> Column:
    """What a scorer is shown of a candidate (columns id, title, journal, year, pubtypes)."""
    types = F.array_join(F.filter(F.coalesce("pubtypes", F.array().cast("array<string>")), lambda t: (t != "") & (t != "Journal Article")), ", ")
    year = F.when(F.coalesce(F.col("year"), F.lit("")) != "", F.concat(F.lit(" ("), "year", F.lit(")"))).otherwise("")
    kinds = F.when(types != "", F.concat(F.lit(" · "), types)).otherwise("")
    evidence = F.substring(X.collapse(F.coalesce(abstract, F.lit(""))), 1, ABSTRACT_CHARS)
    return F.concat(
        F.lit("["), "id", F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n  "), F.coalesce(X.nz(F.col("journal")), F.lit("unknown journal")), year, kinds,
        F.lit("\n  Abstract: "), F.coalesce(X.nz(evidence), F.lit("(not available)")),
    )


def attach_scores(pool: DataFrame, scores: DataFrame) -> DataFrame:
    """The pool (id, idx, …) with clamped scores (id, seq, score): the last of several counts, an
    unlisted id has 0, unknown ids are dropped. Ordered by score, then place in the pool."""
    last = scores.groupBy("id").agg(F.max_by("score", "seq").alias("_raw"))
    out = pool.drop("score", "reason").join(last, "id", "left")
    return out.withColumn("score", clamp_score(F.col("_raw"))).withColumn("reason", F.lit("")).drop("_raw").orderBy(F.desc("score"), "idx")


def score_with(pool: DataFrame, scorer: Callable[[list[str]], list[dict]], shown: Column, size: int = BATCH) -> DataFrame:
    """id, seq, score from a scorer called with up to ``size`` shown candidates at a time; what it
    returns is untrusted, see ``attach_scores``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                got = [g for g in scorer(frame["shown"].iloc[at : at + size].tolist()) if g.get("id") is not None]
                if got:
                    yield pd.DataFrame({"id": [str(g["id"]) for g in got], "seq": range(len(got)), "score": [None if g.get("score") is None else str(g["score"]) for g in got]})

    return pool.select(shown.alias("shown")).mapInPandas(run, "id string, seq long, score string")


def overlap_scorer(criteria: str) -> Callable[[list[str]], list[dict]]:
    """Scores without a model: the share of the criteria's words that a candidate has."""
    import re

    wanted = set(re.findall(r"[a-z]{3,}", criteria.lower()))

    def score(blocks: list[str]) -> list[dict]:
        out = []
        for block in blocks:
            id, _, rest = block[1:].partition("] ")
            out.append({"id": id, "score": 100 * len(wanted & set(re.findall(r"[a-z]{3,}", rest.lower()))) / max(1, len(wanted))})
        return out

    return score


def apply_floor(scored: DataFrame, floor: int = DEFAULT_FLOOR, count: int | None = None, order: tuple[str, ...] = ("idx",)) -> DataFrame:
    """What reaches the floor, best first, ``count`` at most (no or a bad count: all)."""
    cleared = scored.where(F.col("score") >= floor).orderBy(F.desc("score"), *order)
    return cleared.limit(count) if isinstance(count, int) and count >= 0 else cleared


def floor_counts(scored: DataFrame, floor: int = DEFAULT_FLOOR, count: int | None = None) -> DataFrame:
    """One row: total, cleared, picked."""
    rows = scored.agg(F.count("*").alias("total"), F.count_if(F.col("score") >= floor).alias("cleared"))
    picked = F.least("cleared", F.lit(count)) if isinstance(count, int) and count >= 0 else F.col("cleared")
    return rows.withColumn("picked", picked)


def post_read_floor(results: DataFrame, rankings: DataFrame, floor: int = DEFAULT_FLOOR) -> DataFrame:
    """Results (id, idx, error, retracted) to show after reading, with ``place``: those without error
    whose ranking reaches the floor, then those with an error; never retracted ones. No ranking
    fails the floor; a null score counts as 0."""
    ranked = rankings.groupBy("id").agg(F.max(F.struct(F.lit(True).alias("has"), F.coalesce(as_score(F.col("score")), F.lit(0.0)).alias("score"))).alias("r"))
    failed = F.col("error").isNotNull()
    joined = results.where(~F.coalesce("retracted", F.lit(False))).join(ranked, "id", "left")
    kept = joined.where(failed | F.coalesce(F.col("r.score") >= floor, F.lit(False)))
    return kept.select(*results.columns, F.row_number().over(W.orderBy(failed, "idx")).alias("place"))


def with_forced(shown: DataFrame, results: DataFrame, forced: DataFrame) -> DataFrame:
    """What is shown (…, place) and then, in the order of idx, the results that were asked for by id
    (``forced``) though they miss the floor: never those with an error, nor retracted ones."""
    more = results.where(F.col("error").isNull() & ~F.coalesce("retracted", F.lit(False))).join(forced.select("id"), "id", "left_semi").join(shown.select("id"), "id", "left_anti")
    rows = shown.unionByName(more.withColumn("place", F.lit(None).cast("int")))
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.col("place").asc_nulls_last(), "idx")))


def digest_order(results: DataFrame, rankings: DataFrame) -> DataFrame:
    """Results (id, idx, …) with ``place``: the best score after reading first, those without one last;
    ties as they came."""
    scores = rankings.groupBy("id").agg(F.max(as_score(F.col("score"))).alias("_score"))
    joined = results.join(scores, "id", "left")
    return joined.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.coalesce("_score", F.lit(-1.0))), "idx"))).drop("_score")


def post_read_counts(results: DataFrame, rankings: DataFrame, floor: int = DEFAULT_FLOOR) -> DataFrame:
    """One row: total read without error, cleared, excluded."""
    ranked = rankings.groupBy("id").agg(F.max(F.coalesce(as_score(F.col("score")), F.lit(0.0))).alias("s"))
    ok = results.where(~F.coalesce("retracted", F.lit(False)) & F.col("error").isNull()).join(ranked, "id", "left")
    rows = ok.agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col("s") >= floor, F.lit(False))).alias("cleared"))
    return rows.withColumn("excluded", F.col("total") - F.col("cleared"))


def merge_by_id(first: DataFrame, later: DataFrame) -> DataFrame:
    """Rows of both (id, idx, …): a later row replaces an earlier one, at the earlier one's place."""
    rows = first.withColumn("_gen", F.lit(0)).unionByName(later.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in rows.columns if c not in ("id", "idx", "_gen")]
    merged = rows.groupBy("id").agg(F.min(F.struct("_gen", "idx")).alias("_at"), F.max_by(F.struct(*columns), F.struct("_gen", "idx")).alias("_row"))
    return merged.select("id", F.row_number().over(W.orderBy("_at")).alias("idx"), "_row.*")


def display_score(processed: Column, post: Column, pre: Column) -> Column:
    """The score after reading where a paper was read and has one, else the one before."""
    return F.coalesce(F.when(processed, as_score(post)), as_score(pre))


def read_fit_label(score: Column) -> Column:
    n = as_score(score)
    return F.when(n.isNull(), "").otherwise(F.concat(F.lit("fit "), F.format_string("%.0f", n), F.lit(" after reading")))


def below_floor_note(score: Column, floor: Column) -> Column:
    n, bar = as_score(score), as_score(floor)
    note = F.concat(F.format_string("%.0f", n), F.lit(" after reading — below your bar of "), F.format_string("%.0f", bar), F.lit("."))
    return F.when(n.isNull() | bar.isNull() | (n >= bar), "").otherwise(note)


def floor_summary(total: Column, cleared: Column, picked: Column, floor: Column) -> Column:
    s = lambda c: c.cast("string")
    opening = "On title, abstract, and journal, "
    some = F.concat(F.lit(opening), s(cleared), F.lit(" of "), s(total), F.lit(" cleared your bar today (score "), s(floor), F.lit("+)."))
    return (
        F.when(total == 0, "")
        .when(cleared == 0, F.concat(F.lit(f"{opening}nothing cleared your bar today — "), s(total), F.when(total == 1, " paper").otherwise(" papers"), F.lit(" scored, none reached "), s(floor), F.lit(".")))
        .when((cleared < total) & (picked < cleared), F.concat(some, F.lit(" The top "), s(picked), F.lit(" made the digest.")))
        .when(cleared < total, some)
        .when(picked < cleared, F.concat(F.lit(f"{opening}all "), s(total), F.lit(" cleared your bar — the top "), s(picked), F.lit(" made the digest.")))
        .otherwise("")
    )
