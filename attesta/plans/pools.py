"""Queries of the topic merge, the ledger and the selection funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import digests as DG
from ..operators import funnel, ledger, topics
from .registry import query, table

_TOPICS = """
topics AS (SELECT event_type AS label, row_number() OVER (ORDER BY event_type) - 1 AS ti FROM (SELECT DISTINCT event_type FROM events)),
skip AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events WHERE event_type = 'error' AND ts < (SELECT min(ts) FROM events) + INTERVAL 3 DAY),
res AS (SELECT ti, CAST(user_id AS VARCHAR) AS id, min(-epoch_us(ts)) AS pos FROM events JOIN topics ON label = event_type GROUP BY 1, 2),
unseen AS (SELECT *, row_number() OVER (PARTITION BY ti ORDER BY pos, id) - 1 AS depth FROM res WHERE id NOT IN (SELECT id FROM skip)),
kept AS (SELECT * FROM unseen WHERE depth < 10)"""


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events as searches: a type is a topic, its users are what it found, the latest first; users with
    an error in the first three days have been seen."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kinds = events.select(F.col("event_type").alias("label")).distinct()
    # a row per event type, a handful
    found = kinds.select("label", (F.row_number().over(W.orderBy("label")) - 1).alias("topic_idx"), F.lit(40).alias("asked"), F.lit(None).cast("string").alias("error"))
    results = events.withColumnRenamed("event_type", "label").join(F.broadcast(found), "label").select(
        "topic_idx", "label", (-F.unix_micros("ts")).alias("pos"), F.col("user_id").cast("string").alias("id"), "asked", "error"
    )
    start = events.agg(F.min("ts")).collect()[0][0]
    skip = events.where((F.col("event_type") == "error") & (F.col("ts") < F.lit(start) + F.expr("INTERVAL 3 DAYS"))).select(F.col("user_id").cast("string").alias("id")).distinct()
    return results, found, skip


@query(f"""WITH {_TOPICS}
SELECT id, row_number() OVER (ORDER BY min(depth * 1000 + ti)) - 1 AS place, string_agg(label, '|' ORDER BY depth, ti) AS topics
FROM kept JOIN topics USING (ti) GROUP BY id""")
def q01_topic_pool(spark, sf_dir):
    pool = topics.topic_pool(*_inputs(spark, sf_dir))
    return pool.select("id", F.col("place").cast("long").alias("place"), F.array_join("topics", "|").alias("topics"))


@query(f"""WITH {_TOPICS}, n AS (
  SELECT ti, count(*) AS raw, count(*) FILTER (id IN (SELECT id FROM skip)) AS skipped FROM res GROUP BY ti)
SELECT label, least(raw - skipped, 10) AS kept, raw - skipped AS available, skipped, raw >= 40 AS more FROM topics JOIN n USING (ti)""")
def q02_topic_counts(spark, sf_dir):
    counts = topics.topic_counts(*_inputs(spark, sf_dir))
    return counts.select("label", F.col("count").cast("long").alias("kept"), F.col("available").cast("long").alias("available"), F.col("skipped").cast("long").alias("skipped"), "more")


@query(f"""WITH {_TOPICS}
SELECT id, count(*) AS n_topics, string_agg(label, '|' ORDER BY depth, ti) AS topics FROM kept JOIN topics USING (ti) GROUP BY id HAVING count(*) > 1""")
def q03_attribution(spark, sf_dir):
    pool = topics.topic_pool(*_inputs(spark, sf_dir)).where(F.size("topics") > 1)
    return pool.select("id", F.size("topics").cast("long").alias("n_topics"), F.array_join("topics", "|").alias("topics"))


@query("""WITH skip AS (SELECT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0)
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT k FROM skip)""")
def q04_unseen(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    seen = orders.where("o_orderdate >= '1998-01-01'").select(F.col("o_custkey").alias("id"))
    none = F.lit(None).cast("string")
    skip = ledger.skip_set(seen, customer.where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("pmid"), none.alias("id")))
    candidates = customer.select(F.col("c_custkey").cast("string").alias("pmid"), none.alias("id"), F.col("c_name").alias("name"))
    return ledger.unseen(candidates, skip).select(F.col("pmid").alias("id"), "name")


@query("""WITH old AS (SELECT CAST(user_id AS VARCHAR) AS id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_seen FROM events WHERE ts < TIMESTAMP '2024-01-02' GROUP BY 1)
SELECT * FROM old UNION ALL
SELECT DISTINCT CAST(user_id AS VARCHAR), '2024-01-01T00:00:00' FROM events WHERE CAST(user_id AS VARCHAR) NOT IN (SELECT id FROM old)""")
def q11_merge_seen(spark, sf_dir):
    """The stamp of the merge is earlier than those there are, which stay all the same."""
    events = table(spark, sf_dir, "events")
    old = events.where("ts < '2024-01-02'").groupBy(F.col("user_id").cast("string").alias("id")).agg(F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("first_seen"))
    return ledger.merge_seen(old, events.select(F.col("user_id").alias("id")), "2024-01-01T00:00:00")


@query("""SELECT CAST(user_id AS VARCHAR) AS id, strftime(max(ts), '%Y-%m-%dT%H') AS first_seen FROM events GROUP BY user_id
ORDER BY first_seen DESC, id DESC LIMIT 50""")
def q12_cap_ledger(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("id")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH").alias("first_seen"))
    return ledger.cap_ledger(rows, 50)


@query("""WITH failed AS (SELECT doc_id FROM labels WHERE quality = 0)
SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM failed)""")
def q13_stampable(spark, sf_dir):
    pool = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("quality") == 0, "failed").alias("error"))
    return ledger.stampable(pool, outcomes)


@query("""SELECT p_partkey AS idx, CAST(least(greatest(p_size * 2, 0), 100) AS INTEGER) AS score FROM part WHERE p_size * 2 >= 70 ORDER BY score DESC, idx LIMIT 20""")
def q14_floor_then_limit(spark, sf_dir):
    scored = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), funnel.clamp_score(F.col("p_size") * 2).alias("score"))
    return funnel.apply_floor(scored, 70, 20)


_READ = """
res AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS idx, CASE WHEN p_partkey % 70 = 0 THEN 'e' END AS error, p_partkey % 110 = 0 AS retracted FROM part),
rk AS (SELECT CAST(s_suppkey * 10 AS VARCHAR) AS id, floor(abs(s_acctbal)) % 101 AS score FROM supplier)"""


def _read(spark, sf_dir):
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    k = F.col("p_partkey")
    results = part.select(k.cast("string").alias("id"), k.alias("idx"), F.when(k % 70 == 0, "e").alias("error"), (k % 110 == 0).alias("retracted"))
    rankings = supplier.select((F.col("s_suppkey") * 10).cast("string").alias("id"), (F.floor(F.abs("s_acctbal")) % 101).alias("score"))
    return results, rankings


@query(f"""WITH {_READ}
SELECT res.id, row_number() OVER (ORDER BY error IS NOT NULL, idx) AS place FROM res LEFT JOIN rk USING (id)
WHERE NOT retracted AND (error IS NOT NULL OR coalesce(score >= 55, FALSE))""")
def q15_post_read_floor(spark, sf_dir):
    kept = funnel.post_read_floor(*_read(spark, sf_dir), 55)
    return kept.select("id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_READ}, ok AS (SELECT res.id, coalesce(score >= 55, FALSE) AS c FROM res LEFT JOIN rk USING (id) WHERE NOT retracted AND error IS NULL)
SELECT count(*) AS total, count(*) FILTER (c) AS cleared, count(*) FILTER (NOT c) AS excluded FROM ok""")
def q15b_post_read_counts(spark, sf_dir):
    return funnel.post_read_counts(*_read(spark, sf_dir), 55)


@query("""SELECT CAST(conv_id AS VARCHAR) AS id, CAST(least(greatest(floor(coalesce(arg_max(length(text), turn), 0) / 7.0 + 0.5), 0), 100) AS INTEGER) AS score
FROM conversations GROUP BY conv_id""")
def q16_last_score_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    pool = rows.select(F.col("conv_id").cast("string").alias("id"), F.col("conv_id").alias("idx")).distinct()
    scores = rows.select(F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("seq"), (F.length("text") / 7.0).cast("string").alias("score"))
    return funnel.attach_scores(pool, scores).select("id", "score")


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 30) AS BIGINT) AS batch FROM documents")
def q17_batches(spark, sf_dir):
    return funnel.batches(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"]).select("doc_id", "batch")


@query("""WITH rows AS (
  SELECT CAST(user_id AS VARCHAR) AS id, 0 AS gen, min(event_id) AS idx, 'first' AS what FROM events WHERE event_type = 'view' GROUP BY 1
  UNION ALL SELECT CAST(user_id AS VARCHAR), 1, min(event_id), 'later' FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT id, row_number() OVER (ORDER BY min(gen * 1000000000000 + idx)) AS idx, arg_max(what, gen) AS what FROM rows GROUP BY id""")
def q18_merge_by_id(spark, sf_dir):
    events = table(spark, sf_dir, "events")

    def rows(kind: str, what: str) -> DataFrame:
        some = events.where(F.col("event_type") == kind)
        return some.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.min("event_id").alias("idx")).withColumn("what", F.lit(what))

    merged = funnel.merge_by_id(rows("view", "first"), rows("click", "later"))
    return merged.select("id", F.col("idx").cast("long").alias("idx"), "what")


@query("""SELECT count(*) AS total, count(*) FILTER (quality IS NULL) AS missing, count(*) FILTER (quality IS NULL) = 0 AS complete
FROM documents LEFT JOIN labels USING (doc_id)""")
def q38_missing_rankings(spark, sf_dir):
    results = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("error"))
    return ledger.missing_rankings(results, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("""SELECT o_orderkey, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02'), 0) AS days FROM orders""")
def q50_age_days(spark, sf_dir):
    saved = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    days = DG.age_days(saved, F.lit("1998-08-02").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", days.cast("long").alias("days"))


@query("""WITH raw AS (SELECT p_brand AS list_id, p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE trim(p_name) END AS label, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type || ' ' || CAST(p_size AS VARCHAR) END AS query FROM part),
full_rows AS (SELECT list_id, pos, coalesce(label, query) AS label, coalesce(query, label) AS query FROM raw WHERE label IS NOT NULL OR query IS NOT NULL)
SELECT list_id, pos, label, query FROM (SELECT *, row_number() OVER (PARTITION BY list_id, lower(query) ORDER BY pos) AS n FROM full_rows) WHERE n = 1""")
def q51_normalize_topics(spark, sf_dir):
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    label = F.when(k % 3 != 0, F.concat(F.lit(" "), "p_name"))
    text = F.when(k % 5 != 0, F.concat("p_type", F.lit(" "), "p_size"))
    half = k % 2 == 0
    raw = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("list_id"), k.alias("pos"), F.when(half, label).alias("label"), F.when(~half, label).alias("topic"), none.alias("name"),
        F.when(half, text).alias("query"), none.alias("term"), F.when(~half, text).alias("q"), none.alias("text"),
    )
    return topics.normalize_topics(raw)


@query(f"""WITH {_TOPICS}, n AS (SELECT ti, count(*) AS raw, count(*) FILTER (id IN (SELECT id FROM skip)) AS sk FROM res GROUP BY ti),
c AS (SELECT ti, label, least(raw - sk, 10) AS kept, raw - sk AS available, raw >= 40 AS more FROM topics JOIN n USING (ti))
SELECT 'Searched ' || count(*) || ' topics over the last 3 days — 7 new papers.' || coalesce(' Per topic: ' || string_agg(label || ' ' || kept || ' of ' || available || CASE WHEN more THEN '+' ELSE '' END, ', ' ORDER BY ti) FILTER (kept < available OR more)
  || ' — raise "per topic" in your profile to see more.', '') AS summary FROM c""")
def q54_search_summary(spark, sf_dir):
    return topics.search_summary(topics.topic_counts(*_inputs(spark, sf_dir)), 3, 7)


@query("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 = 0 THEN 70 ELSE least(greatest(floor(p_retailprice / 10.0 + 0.5), 0), 100) END AS INTEGER) AS bar,
 CAST(greatest(CASE WHEN p_partkey % 4 = 0 THEN 70 ELSE least(greatest(floor(p_retailprice / 10.0 + 0.5), 0), 100) END - 20, 0) AS INTEGER) AS pre,
 CAST(CASE WHEN p_partkey % 4 = 0 THEN 3 ELSE least(greatest(floor(p_size + 0.5), 1), 90) END AS INTEGER) AS days FROM part""")
def q55_clamps(spark, sf_dir):
    gone = F.col("p_partkey") % 4 == 0
    raw = lambda c: F.when(~gone, c.cast("string")).otherwise(F.lit(" "))
    price, size = raw(F.col("p_retailprice") / 10.0), raw(F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", funnel.score_floor(price).alias("bar"), funnel.pre_read_floor(price).alias("pre"), topics.search_days(size).alias("days"))


@query()
def q70_digest_run(spark, sf_dir):
    """A whole run over documents: their sources are the topics, stand-ins are the models. Extraction and
    takes are no SQL; the tests hold runs against worked examples."""
    from .. import schemas
    from ..operators import runs

    documents = table(spark, sf_dir, "documents")
    id = F.col("doc_id").cast("string")
    none = lambda t: F.lit(None).cast(t)
    number = F.substring("source", 4, 9).cast("int")
    results = documents.select(number.alias("topic_idx"), F.col("source").alias("label"), F.col("doc_id").alias("pos"), id.alias("id"), F.lit(40).alias("asked"), none("string").alias("error"))
    heads = documents.select(number.alias("topic_idx"), F.col("source").alias("label"), F.lit(40).alias("asked"), none("string").alias("error")).distinct()
    seen = documents.where("doc_id % 10 = 0").select(id.alias("id"), F.lit("2024-01-01").alias("first_seen"))
    cited = documents.select(
        id.alias("pmid"), none("string").alias("url"), none("string").alias("author"), F.lit("2024").alias("year"), F.col("source").alias("journal"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"),
        none("string").alias("doi"), none("array<string>").alias("pubtypes"), (F.col("doc_id") % 7 == 0).alias("retracted"), F.lit(True).alias("verified"),
    )
    registry = none(schemas.CLAIM.rpartition("registry ")[2])
    sources = documents.select(id.alias("id"), "text", F.lit("").alias("tables"), F.lit("full_text").alias("tier"), registry.alias("registry"))
    inputs = runs.Inputs(results, heads, seen, spark.createDataFrame([], "pmid string, id string"), cited, sources)
    settings = runs.Settings(criteria="the and that with from", now="2024-02-01", floor=60, count=25)
    done = runs.run_digest(inputs, settings)
    return done.shown.select("id", F.col("place").cast("long").alias("place"))
