"""Per-topic search results, merged into one pool.

Skip what was seen, *then* cap each topic: the other order would let old papers use up a topic's
places. Merging goes round the topics, one place at a time; a paper that several topics found keeps
its first place and names them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

DEFAULT_DAYS, MOST_DAYS = 3, 90
DEFAULT_CAP, MOST_CAP = 10, 50
MOST_ASKED = 100
LOOKBACKS = (7, 30, 90)


def _clamped(raw: Column, default: int, least: int, most: int) -> Column:
    """A number from free text, rounded half up and clamped; the default without one."""
    n = F.expr("try_cast(NULL as double)") if raw is None else X.nz(X.trim(raw.cast("string"))).try_cast("double")
    fine = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    return F.when(fine, F.least(F.greatest(F.floor(n + 0.5), F.lit(least)), F.lit(most))).otherwise(default).cast("int")


def search_days(raw: Column) -> Column:
    return _clamped(raw, DEFAULT_DAYS, 1, MOST_DAYS)


def topic_cap(raw: Column) -> Column:
    return _clamped(raw, DEFAULT_CAP, 1, MOST_CAP)


def overfetch(cap: Column, days: Column) -> Column:
    """How many to ask for, so that a topic is full even after skipping."""
    return F.least(topic_cap(cap) * (1 + search_days(days)), F.lit(MOST_ASKED))


def lookback_options(days: Column) -> Column:
    """Wider windows that may be offered; a window never widens by itself."""
    return F.filter(F.array(*map(F.lit, LOOKBACKS)), lambda d: d > search_days(days))


def clean_results(results: DataFrame) -> DataFrame:
    """Results (topic_idx, label, pos, id) with ids as trimmed text, each once per topic at its first
    place, without blanks."""
    ids = results.withColumn("id", X.trim(F.col("id").cast("string"))).where("error IS NULL AND id <> ''")
    return ids.groupBy("topic_idx", "id").agg(F.min("pos").alias("pos"))


def unseen_per_topic(results: DataFrame, skip: DataFrame, cap: int = DEFAULT_CAP) -> DataFrame:
    """topic_idx, id, depth: the first ``cap`` unseen results of each topic. The skip set is anti-joined
    (broadcast only if the planner finds it small), and the window keeps a bounded head per topic."""
    unseen = clean_results(results).join(skip.select("id").distinct(), "id", "left_anti")
    depth = F.row_number().over(W.partitionBy("topic_idx").orderBy("pos", "id")) - 1
    return unseen.withColumn("depth", depth).where(F.col("depth") < cap)


def topic_pool(results: DataFrame, topics: DataFrame, skip: DataFrame, cap: int = DEFAULT_CAP) -> DataFrame:
    """id, place (from 0), topics (labels in the order in which they reached the paper)."""
    kept = unseen_per_topic(results, skip, cap).join(topics.select("topic_idx", "label"), "topic_idx")
    pool = kept.groupBy("id").agg(
        F.min(F.struct("depth", "topic_idx")).alias("first"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("depth", "topic_idx", "label"))), lambda x: x["label"])).alias("topics"),
    )
    # topics x cap rows at most
    place = F.row_number().over(W.orderBy("first")) - 1
    return pool.select("id", place.alias("place"), "topics")


def topic_counts(results: DataFrame, topics: DataFrame, skip: DataFrame, cap: int = DEFAULT_CAP) -> DataFrame:
    """topic_idx, label, error, count (kept), available (unseen), skipped, more: a row per topic, with
    zeros for one that found nothing and an error instead of counts for one that failed."""
    found = clean_results(results).join(skip.select("id", F.lit(1).alias("seen")).distinct(), "id", "left")
    n = found.groupBy("topic_idx").agg(F.count("*").alias("raw"), F.count("seen").alias("skipped"))
    rows = topics.join(n, "topic_idx", "left").fillna(0, ["raw", "skipped"])
    available = F.col("raw") - F.col("skipped")
    ok = F.col("error").isNull()
    return rows.select(
        "topic_idx", "label", "error", F.when(ok, F.least(available, F.lit(cap))).alias("count"), F.when(ok, available).alias("available"),
        F.when(ok, F.col("skipped")).alias("skipped"), F.when(ok, (F.col("asked") > 0) & (F.col("raw") >= F.col("asked"))).alias("more"),
    )


def held_back(counts: DataFrame) -> DataFrame:
    """Topics that have more than was kept."""
    return counts.where((F.col("count") < F.col("available")) | F.col("more"))


def attach_topics(candidates: DataFrame, pool: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return candidates.drop("topics").join(pool.select("id", "topics"), "id", "left").withColumn("topics", F.coalesce("topics", none))


def candidates(results: DataFrame, topics: DataFrame, skip: DataFrame, citations: DataFrame, cap: int = DEFAULT_CAP) -> DataFrame:
    """The pool with its citations, in order, without retracted papers. Citations are joined only
    once the pool is cut, so few of their rows are read past the join."""
    from .retractions import citation_retracted

    pool = topic_pool(results, topics, skip, cap)
    cited = citations.where(F.col("verified")).withColumn("citation", F.struct(*(c for c in citations.columns)))
    return pool.join(cited.select(F.col("pmid").alias("id"), "citation"), "id").where(~citation_retracted(F.col("citation"))).orderBy("place")


def search_summary(counts: DataFrame, days: int, found: int | None = None) -> DataFrame:
    """One row, ``summary``: the search in a sentence, with what failed, was quiet, or was held back."""
    plural = lambda n: F.when(n == 1, "").otherwise("s")
    ok = F.col("error").isNull()
    ordered = lambda x, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("topic_idx", x.alias("x"))))), lambda r: r["x"])
    held = F.concat_ws("", "label", F.lit(" "), "count", F.lit(" of "), "available", F.when(F.col("more"), "+"))
    agg = counts.agg(
        F.count("*").alias("n"), ordered(F.col("label"), ~ok).alias("failed"), ordered(F.col("label"), ok & (F.col("count") == 0)).alias("quiet"),
        ordered(held, ok & ((F.col("count") < F.col("available")) | F.col("more"))).alias("held"),
    )
    names = lambda c: F.array_join(F.filter(c, lambda x: x != ""), ", ")
    head = F.concat(F.lit("Searched "), F.col("n"), F.lit(" topic"), plural(F.col("n")), F.lit(f" over the last {days} day{'' if days == 1 else 's'}"))
    new = F.lit("" if found is None else f" — {found} new paper{'' if found == 1 else 's'}")
    failed = F.when(
        F.size("failed") > 0,
        F.concat(F.lit(" "), F.size("failed"), F.lit(" topic"), plural(F.size("failed")), F.lit(" failed to search"), F.when(names("failed") != "", F.concat(F.lit(": "), names("failed"))).otherwise(""), F.lit(" — those areas aren't covered today.")),
    ).otherwise("")
    quiet = F.when(F.size("quiet") > 0, F.concat(F.lit(" No new matches for "), names("quiet"), F.lit("."))).otherwise("")
    more = F.when(F.size("held") > 0, F.concat(F.lit(" Per topic: "), F.array_join("held", ", "), F.lit(' — raise "per topic" in your profile to see more.'))).otherwise("")
    return agg.select(F.when(F.col("n") == 0, "").otherwise(F.concat(head, new, F.lit("."), failed, quiet, more)).alias("summary"))


def normalize_topics(raw: DataFrame) -> DataFrame:
    """list_id, pos, label, query from rows (list_id, pos, label, topic, name, query, term, q, text):
    aliases resolved, half rows completed, each query once at its first place."""
    text = lambda *names: F.coalesce(*(X.trim(F.col(n).cast("string")) for n in names), F.lit(""))
    bare = X.trim(F.coalesce(F.col("text"), F.lit("")))
    label, query = text("label", "topic", "name"), text("query", "term", "q")
    q = F.coalesce(X.nz(query), X.nz(label), X.nz(bare), F.lit(""))
    rows = raw.select("list_id", "pos", F.coalesce(X.nz(label), X.nz(query), X.nz(bare)).alias("label"), q.alias("query")).where("query <> ''")
    first = F.row_number().over(W.partitionBy("list_id", F.lower("query")).orderBy("pos"))
    return rows.withColumn("n", first).where("n = 1").drop("n")


_TOPIC = "struct<label:string,topic:string,name:string,query:string,term:string,q:string>"


def parse_topics_text(pasted: DataFrame) -> DataFrame:
    """Topics from pasted text (list_id, text): a JSON list, a fragment of one, an object with
    ``topics``, else a topic per line, split at the first tab or colon; comments and bullets go."""
    raw = X.trim(F.coalesce(F.col("text"), F.lit("")))
    wrapped = F.concat(F.lit("["), F.regexp_replace(raw, ",(?U:\\s*)$", ""), F.lit("]"))
    as_array = lambda c: F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, f"array<{_TOPIC}>"))
    as_strings = F.when(F.try_parse_json(raw).isNotNull() & raw.startswith("["), F.from_json(raw, "array<string>"))
    in_object = F.from_json(raw, f"struct<topics:array<{_TOPIC}>>")["topics"]
    objects = F.when(raw.startswith("{"), F.coalesce(F.when(F.try_parse_json(raw).isNotNull(), in_object), as_array(wrapped))).when(raw.startswith("["), as_array(raw))
    # a list of plain strings stands beside as many empty objects
    objects = F.coalesce(objects, F.transform(as_strings, lambda _: F.lit(None).cast(_TOPIC)))
    rows = pasted.select("list_id", raw.alias("raw"), objects.alias("objects"), as_strings.alias("strings"))
    is_json = F.col("objects").isNotNull()
    fields = [F.col(f"o.{n}").alias(n) for n in ("label", "topic", "name", "query", "term", "q")]
    json = rows.where(is_json).select("list_id", F.posexplode("objects").alias("pos", "o"), F.col("strings")).select(
        "list_id", "pos", *fields, F.when(~F.get("strings", F.col("pos")).startswith("{"), F.get("strings", F.col("pos"))).alias("text")
    )
    lines = rows.where(~is_json & (F.col("raw") != "")).select("list_id", F.posexplode(F.split("raw", "\r?\n")).alias("pos", "line"))
    row = F.regexp_replace(X.trim(F.col("line")), "^[-*•](?U:\\s+)", "")
    lines = lines.withColumn("row", row).where(~F.col("row").rlike("^(//|#)") & (F.col("row") != ""))
    at = F.when(F.instr("row", "\t") > 1, F.instr("row", "\t")).when(F.instr("row", ":") > 1, F.instr("row", ":"))
    label = F.when(at.isNotNull(), F.substring(F.col("row"), F.lit(1), at - 1)).otherwise(F.col("row"))
    query = F.when(at.isNotNull(), F.substring(F.col("row"), at + 1, F.length("row"))).otherwise(F.col("row"))
    none = F.lit(None).cast("string")
    lines = lines.select("list_id", "pos", label.alias("label"), none.alias("topic"), none.alias("name"), query.alias("query"), none.alias("term"), none.alias("q"), none.alias("text"))
    return normalize_topics(json.unionByName(lines))


def topics_from_stars(stars: DataFrame) -> DataFrame:
    """Topics from a profile's interests (list_id, pos, star)."""
    none = F.lit(None).cast("string")
    return normalize_topics(stars.select("list_id", "pos", *(none.alias(n) for n in ("label", "topic", "name", "query", "term", "q")), F.col("star").alias("text")))


#: Fixed value: what is searched if a profile names nothing.
FALLBACK = ("Vascular surgery", "vascular surgery")


def profile_topics(profiles: DataFrame, raw: DataFrame, stars: DataFrame) -> DataFrame:
    """list_id, pos, label, query for every profile (list_id): its own topics (as for
    ``normalize_topics``), else those made of its interests, else the fallback."""
    own = normalize_topics(raw.join(profiles.select("list_id"), "list_id", "left_semi"))
    derived = topics_from_stars(stars.join(profiles.select("list_id"), "list_id", "left_semi")).join(own.select("list_id").distinct(), "list_id", "left_anti")
    some = own.unionByName(derived)
    rest = profiles.select("list_id").distinct().join(some.select("list_id").distinct(), "list_id", "left_anti")
    kind = own.schema["pos"].dataType
    return some.unionByName(rest.select("list_id", F.lit(0).cast(kind).alias("pos"), F.lit(FALLBACK[0]).alias("label"), F.lit(FALLBACK[1]).alias("query")))


def set_row(rows: Column, at: Column, label: Column | None = None, query: Column | None = None) -> Column:
    """A list of topics, array<struct<label, query>>, with the fields given changed in the row ``at``."""
    new = lambda field, old: old if field is None else field
    return F.transform(rows, lambda t, i: F.when(i == at, F.struct(new(label, t["label"]).alias("label"), new(query, t["query"]).alias("query"))).otherwise(t))


def remove_row(rows: Column, at: Column) -> Column:
    return F.filter(rows, lambda _, i: i != at)


def add_row(rows: Column) -> Column:
    """With an empty row at the end."""
    return F.concat(rows, F.array(F.struct(F.lit("").alias("label"), F.lit("").alias("query"))))


def apply_paste(current: DataFrame, pasted: DataFrame) -> DataFrame:
    """Topics (list_id, pos, label, query): of each list those of its pasted text (list_id, text), if any
    can be read from it, else those it has."""
    read = parse_topics_text(pasted)
    return current.join(read.select("list_id").distinct(), "list_id", "left_anti").unionByName(read.withColumn("pos", F.col("pos").cast(current.schema["pos"].dataType)).select(*current.columns))


def preview(results: DataFrame, topics: DataFrame, limit: int = 10) -> DataFrame:
    """A few distinct results, round the topics, each under the first topic that reached it."""
    none = results.sparkSession.createDataFrame([], "id string")
    pool = topic_pool(results, topics, none, limit)
    return pool.where(F.col("place") < limit).select("id", "place", F.get("topics", F.lit(0)).alias("topic"))
