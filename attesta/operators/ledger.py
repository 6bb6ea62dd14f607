"""The ledger of what was seen: first come, first kept, and bounded."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

CAPACITY = 5000


def seen_id(pmid: Column, id: Column) -> Column:
    """A candidate's key: its pmid, else its id, as text; empty without either."""
    return F.coalesce(pmid.cast("string"), id.cast("string"), F.lit(""))


def normalize_ledger(raw: DataFrame) -> DataFrame:
    """id, first_seen from ledgers stored as JSON {ids: {id: stamp}}; a bad stamp is kept as ''."""
    ids = F.from_json(F.get_json_object("ledger", "$.ids"), "map<string,string>")
    stamp = F.when(F.coalesce(F.col("stamp"), F.lit("")).rlike("^[0-9]{4}-"), F.col("stamp")).otherwise("")
    return raw.select(F.explode(ids).alias("id", "stamp")).where("trim(id) <> ''").select("id", stamp.alias("first_seen"))


def skip_set(ledger: DataFrame, library: DataFrame) -> DataFrame:
    """id: all that the ledger or the library (pmid, id) has."""
    saved = library.select(seen_id(F.col("pmid"), F.col("id")).alias("id"))
    return ledger.select(F.col("id").cast("string").alias("id")).unionByName(saved).where("id <> ''").distinct()


def unseen(candidates: DataFrame, skip: DataFrame) -> DataFrame:
    keyed = candidates.withColumn("_id", seen_id(F.col("pmid"), F.col("id"))).where("_id <> ''")
    return keyed.join(skip.select(F.col("id").alias("_id")), "_id", "left_anti").drop("_id")


def merge_seen(ledger: DataFrame, new_ids: DataFrame, now: str) -> DataFrame:
    """The ledger with new ids stamped ``now``. What is there stays as it is, even if its stamp is later."""
    fresh = new_ids.select(F.col("id").cast("string").alias("id")).where("id <> ''").distinct()
    return ledger.select("id", "first_seen").unionByName(fresh.join(ledger, "id", "left_anti").withColumn("first_seen", F.lit(now)))


def ledger_limit(most: float | None) -> int:
    return CAPACITY if most is None or not math.isfinite(most) or most < 0 else math.floor(most)


def cap_ledger(ledger: DataFrame, most: float | None = CAPACITY) -> DataFrame:
    """The newest ``most`` entries; of equal stamps those of the larger ids. A top-k, taken per
    partition first, so no task sees the whole ledger."""
    return ledger.orderBy(F.desc("first_seen"), F.desc("id")).limit(ledger_limit(most))


def stampable(pool: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Ids of the pool to stamp after a run (outcomes: id, error): none if everything failed, else all
    but the failed ones."""
    failed = outcomes.where("error IS NOT NULL").select("id").distinct()
    any_ok = outcomes.agg((F.count("*") == 0) | F.bool_or(F.col("error").isNull())).collect()[0][0]
    return pool.select("id").distinct().join(failed, "id", "left_anti").where(F.lit(bool(any_ok)))


def missing_rankings(results: DataFrame, rankings: DataFrame) -> DataFrame:
    """One row: total results, and how many without an error lack a ranking (complete: none)."""
    have = rankings.select("id", F.lit(True).alias("ranked")).distinct()
    joined = results.join(have, "id", "left")
    lacks = F.col("id").isNotNull() & F.col("error").isNull() & F.col("ranked").isNull()
    return joined.agg(F.count("*").alias("total"), F.count_if(lacks).alias("missing")).withColumn("complete", F.col("missing") == 0)
