"""What has to be written out again: records newer than their last write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def basis() -> Column:
    """When a record last changed: saved, else updated, else created; blank counts as absent."""
    return F.coalesce(X.nz(F.col("savedAt")), X.nz(F.col("updatedAt")), X.nz(F.col("createdAt")))


def needs_write() -> Column:
    """Never written, or changed since: stamps are ISO text and compare as such."""
    stamp = X.nz(F.col("vaultWrittenAt"))
    return stamp.isNull() | F.coalesce(stamp < basis(), F.lit(False))


def stamp(now: str) -> Column:
    """The stamp of a write now; never before the record's own time, whatever the clock says."""
    return F.greatest(F.lit(now), basis())


def weekend_key() -> Column:
    return F.concat(F.lit("weekend:"), F.substring(F.coalesce("createdAt", F.lit("")), 1, 10))


def stale(records: DataFrame, type: str | None = None) -> DataFrame:
    """Records (savedAt, updatedAt, createdAt, vaultWrittenAt) to write, the oldest change first."""
    rows = records.where(needs_write())
    return (rows if type is None else rows.where(F.col("type") == type)).orderBy(F.asc_nulls_first(basis()))


def stale_concepts(stale_papers: DataFrame) -> DataFrame:
    """Concepts whose notes list a stale paper."""
    return stale_papers.where("conceptId IS NOT NULL").select("conceptId").distinct()


def drain(papers: DataFrame, digests: DataFrame, memos: DataFrame) -> dict[str, DataFrame]:
    todo = papers.where(needs_write())
    weekends = digests.where("type = 'weekend'").where(needs_write()).orderBy("createdAt")
    return {"papers": todo, "weekends": weekends, "memos": stale(memos), "concepts": stale_concepts(todo)}


def stamped(records: DataFrame, written: DataFrame, now: str) -> DataFrame:
    """All records, those that were written (id) stamped."""
    done = written.select("id", F.lit(True).alias("_done")).distinct()
    out = records.join(done, "id", "left").withColumn("vaultWrittenAt", F.when(F.col("_done"), stamp(now)).otherwise(F.col("vaultWrittenAt")))
    return out.select(*records.columns)
