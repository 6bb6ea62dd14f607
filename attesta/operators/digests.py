"""The daily digest's slot, its age, and what it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

SLOT = "daily:latest"
STATE = "results array<struct<id:string,error:string>>, processedResults array<string>, triaged map<string,string>, candidates array<string>, selectedIds array<string>"


def serialize(state: DataFrame, now: str) -> DataFrame:
    """key, value: the state as the JSON of the one daily slot."""
    body = F.struct(F.lit("daily").alias("kind"), F.lit(now).alias("savedAt"), *state.columns)
    return state.select(F.lit(SLOT).alias("key"), F.to_json(body).alias("value"))


def revive(rows: DataFrame) -> DataFrame:
    """savedAt and state from stored JSON; anything that is no daily digest is dropped, and what is
    missing is empty."""
    ddl = "struct<kind:string,savedAt:string," + ",".join(f"{p.split()[0]}:{p.split(' ', 1)[1]}" for p in STATE.split(", ")) + ">"
    parsed = rows.select(F.from_json("value", ddl).alias("d")).where("d.kind = 'daily'")
    empty = {"results": "array<struct<id:string,error:string>>", "processedResults": "array<string>", "candidates": "array<string>", "selectedIds": "array<string>"}
    filled = [F.coalesce(f"d.{c}", F.array().cast(t)).alias(c) for c, t in empty.items()]
    return parsed.select("d.savedAt", *filled, F.coalesce("d.triaged", F.create_map().cast("map<string,string>")).alias("triaged"))


def with_oa_links(results: DataFrame, resolved: DataFrame) -> DataFrame:
    """Results (id, has_oa, oa) with links (id, link) where none was looked up yet: an absent link and
    a link known not to exist are different."""
    found = resolved.select("id", F.lit(True).alias("_hit"), F.col("link").alias("_link"))
    fill = ~F.col("has_oa") & F.coalesce("_hit", F.lit(False))
    return results.join(found, "id", "left").withColumn("oa", F.when(fill, F.col("_link")).otherwise(F.col("oa"))).withColumn("has_oa", F.col("has_oa") | fill).drop("_hit", "_link")


def age_days(saved: Column, now: Column) -> Column:
    """Whole calendar days; none in the future, or without a date."""
    return F.greatest(F.coalesce(F.datediff(F.to_date(now), F.to_date(F.try_to_timestamp(saved))), F.lit(0)), F.lit(0))


def date_line(saved: Column, now: Column) -> Column:
    """struct<text, stale, days>."""
    at = F.try_to_timestamp(saved)
    days = age_days(saved, now)
    full, short = "EEEE, MMMM d, yyyy", "EEEE, MMMM d"
    age = F.when(days == 1, F.lit("Yesterday's digest")).otherwise(F.concat(days, F.lit(" days old")))
    text = F.when(days > 0, F.concat(age, F.lit(" · "), F.date_format(at, short))).otherwise(F.date_format(F.coalesce(at, now), full))
    return F.struct(text.alias("text"), (days > 0).alias("stale"), days.alias("days"))


def day_label(at: Column, now: Column) -> Column:
    """Jan 5, with the year if it is another."""
    return F.when(F.year(at) == F.year(now), F.date_format(at, "MMM d")).otherwise(F.date_format(at, "MMM d, yyyy"))


def restore_note(missing: Column) -> Column:
    some = F.concat(
        F.lit("Restored your last digest — "), missing.cast("string"), F.when(missing == 1, " paper has").otherwise(" papers have"),
        F.lit(" no summary (the run didn't finish). Finish it below to keep what's already verified, or run again for a fresh scan."),
    )
    return F.when(missing == 0, "Restored your last digest — run again for fresh results.").otherwise(some)


def rank_labels(ordered: Column) -> Column:
    """01, 02, …"""
    return F.lpad(ordered.cast("string"), 2, "0")


def latest_weekend(digests: DataFrame) -> DataFrame:
    return digests.where("type = 'weekend'").groupBy().agg(F.max_by("read", "createdAt").alias("read"))


def toggle(selected: DataFrame, id: str, locked: DataFrame) -> DataFrame:
    """The selection (id) with one id added or taken away; a locked id stays as it is."""
    one = selected.sparkSession.createDataFrame([(id,)], "id string").join(locked.select("id"), "id", "left_anti")
    return selected.join(one, "id", "left_anti").unionByName(one.join(selected, "id", "left_anti"))


def sort_memos(memos: DataFrame) -> DataFrame:
    return memos.orderBy(F.desc(F.coalesce(X.nz(F.col("updatedAt")), F.col("createdAt"), F.lit(""))))


def memo_label(text: Column) -> Column:
    """The first line that isn't empty."""
    lines = F.filter(F.split(X.trim(F.coalesce(text, F.lit(""))), "\r?\n"), lambda x: x != "")
    return X.trim(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))


def add_label(items: Column, label: Column) -> Column:
    """A profile's list with a label, unless it is blank or there already, case aside."""
    have = F.exists(items, lambda x: X.key_of(x) == X.key_of(label))
    return F.when((X.key_of(label) == "") | have, items).otherwise(F.array_append(items, X.trim(label)))


def attach_memos(papers: DataFrame, memos: DataFrame) -> DataFrame:
    """Papers with memos (paper_id, id, text, createdAt) put under their notes, each memo once."""
    text = X.trim(F.coalesce(F.col("text"), F.lit("")))
    date = F.substring(F.coalesce("createdAt", F.lit("")), 1, 10)
    heading = F.when(date != "", F.concat(F.lit("Memo — "), date)).otherwise("Memo")
    blocks = memos.where(text != "").select("paper_id", F.struct("createdAt", "id", F.concat(heading, F.lit("\n"), text).alias("block")).alias("m"))
    per = blocks.groupBy(F.col("paper_id").alias("id")).agg(F.array_sort(F.collect_set("m")).alias("_m"))
    none = F.array().cast("array<string>")
    joined = papers.join(per, "id", "left").withColumn("memoIds", F.coalesce("memoIds", none))
    fresh = F.filter("_m", lambda m: ~F.array_contains("memoIds", m["id"]))
    out = joined.withColumn("_new", F.coalesce(fresh, F.array().cast("array<struct<createdAt:string,id:string,block:string>>")))
    notes = F.concat_ws("\n\n", X.nz(X.trim(F.coalesce("notes", F.lit("")))), F.transform("_new", lambda m: m["block"]))
    out = out.withColumn("notes", F.when(F.size("_new") > 0, notes).otherwise(F.col("notes"))).withColumn("memoIds", F.concat("memoIds", F.transform("_new", lambda m: m["id"])))
    return out.select(*papers.columns)
