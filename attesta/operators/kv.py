"""The key-value document store: rows (user_id, collection, key, value, updated_at), the last write wins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COLLECTIONS = ("profile", "papers", "digests", "graphNodes", "graphEdges", "domains", "seen", "memos")
DEVICE_LOCAL = (("profile", "libraryHandle"),)
BATCH, PAGE = 200, 1000
KEY = ["user_id", "collection", "key"]


def device_local(collection: Column, key: Column) -> Column:
    out = F.lit(False)
    for c, k in DEVICE_LOCAL:
        out = out | ((collection == c) & (key == k))
    return out


def scoped(rows: DataFrame, user_id: str) -> DataFrame:
    """The rows of one user, the only ones that user may see or write."""
    return rows.where(F.col("user_id") == user_id)


def get(rows: DataFrame, collection: str, key: str) -> DataFrame:
    return rows.where((F.col("collection") == collection) & (F.col("key") == key))


def scan(rows: DataFrame, collection: str) -> DataFrame:
    return rows.where(F.col("collection") == collection)


def page(rows: DataFrame, after: str | None = None, size: int = PAGE) -> DataFrame:
    """The next page in the order of keys, after the last key of the one before: each page is a top-k,
    never a skip over all earlier rows."""
    return (rows if after is None else rows.where(F.col("key") > after)).orderBy("key").limit(size)


def pages(rows: DataFrame, size: int = PAGE) -> Iterator[list]:
    """All pages, until a short one."""
    after = None
    while True:
        got = page(rows, after, size).collect()
        if got:
            yield got
        if len(got) < size:
            return
        after = got[-1]["key"]


def kv_rows(values: DataFrame, user_id: str, now: str) -> DataFrame:
    """Rows for (collection, key, value), stamped now by the writer."""
    return values.select(F.lit(user_id).alias("user_id"), "collection", F.col("key").cast("string").alias("key"), "value", F.lit(now).alias("updated_at"))


def upsert(rows: DataFrame, new: DataFrame) -> DataFrame:
    """The store after writing ``new``: one row per key, the latest. Keys are unique in the store, so
    only what is new is aggregated and the rest passes an anti-join."""
    latest = latest_writes(new)
    return rows.join(latest, KEY, "left_anti").select(*rows.columns).unionByName(latest.select(*rows.columns))


def latest_writes(writes: DataFrame) -> DataFrame:
    """The last write of every key (updated_at, then value)."""
    rest = [c for c in writes.columns if c not in KEY]
    return writes.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("updated_at", "value")).alias("_v")).select(*KEY, "_v.*")


def delete(rows: DataFrame, collection: str, key: str | None = None) -> DataFrame:
    """Without one key, or without a collection."""
    gone = F.col("collection") == collection
    return rows.where(~(gone if key is None else gone & (F.col("key") == key)))


def clear_user(rows: DataFrame, user_id: str, all_data: bool = True) -> DataFrame:
    """Start over: without any of a user's rows, or without the profile only."""
    mine = F.col("user_id") == user_id
    return rows.where(~(mine if all_data else mine & (F.col("collection") == "profile")))


def migration_rows(entries: DataFrame, user_id: str, now: str) -> DataFrame:
    """What moves from a device to an account: known collections, nothing that belongs to the device
    alone, and only values that are JSON."""
    fine = F.col("collection").isin(*COLLECTIONS) & ~device_local(F.col("collection"), F.col("key").cast("string")) & F.try_parse_json("value").isNotNull()
    return kv_rows(entries.where(fine), user_id, now)


def batched(rows: DataFrame, size: int = BATCH) -> DataFrame:
    """Rows with ``batch``, of ``size`` in key order within each collection."""
    n = F.row_number().over(W.partitionBy("collection").orderBy("key")) - 1
    return rows.withColumn("batch", F.floor(n / size))


def should_offer_migration(local: DataFrame, cloud: DataFrame) -> bool:
    return not local.isEmpty() and cloud.isEmpty()


def log_event(user_id: str | None, type: str, payload: str, spark, ts) -> DataFrame | None:
    """An event row to append; none if nobody is signed in."""
    if not user_id:
        return None
    return spark.createDataFrame([(user_id, ts, type, payload)], "user_id string, ts timestamp, type string, payload string")
