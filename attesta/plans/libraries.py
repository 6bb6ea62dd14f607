"""Queries of the library, the drain, notes, the key-value store and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import render
from ..operators import digests, drain, kv, library, projects
from .registry import query, table


def _library(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations as concepts with regions as domains and hubs, customers as papers: one in three names its
    concept, one in three is cited by it, the others live nowhere."""
    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    none = F.array().cast("array<string>")
    n, k = F.col("n_nationkey"), F.col("c_custkey")
    cites = customer.where(k % 3 == 1).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_list(k.cast("string")).alias("sourcePmids"))
    concepts = nation.join(cites, "n_nationkey", "left").select(
        F.concat(F.lit("n"), n).alias("id"), F.col("n_name").alias("label"), F.lit("").alias("summary"), F.concat(F.lit("r"), "n_regionkey").alias("domain"), none.alias("tags"),
        F.coalesce("sourcePmids", none).alias("sourcePmids"), F.lit(False).alias("isHub"), n.cast("long").alias("pos"),
    )
    hubs = region.select(
        F.concat(F.lit("hub"), "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lit("").alias("summary"), F.concat(F.lit("r"), "r_regionkey").alias("domain"), none.alias("tags"),
        none.alias("sourcePmids"), F.lit(True).alias("isHub"), (F.col("r_regionkey") + 100).cast("long").alias("pos"),
    )
    papers = customer.select(
        k.cast("string").alias("id"), k.cast("string").alias("pmid"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("finding"), F.lit("").alias("notes"), none.alias("tags"),
        F.when(k % 2 == 0, "r0").otherwise("r1").alias("domain"), F.when(k % 3 == 0, F.concat(F.lit("n"), "c_nationkey")).alias("conceptId"),
    )
    edges = nation.select(F.concat(F.lit("n"), n).alias("source"), F.concat(F.lit("hub"), "n_regionkey").alias("target"), F.lit("taxonomy").alias("origin"), n.cast("long").alias("pos"))
    return concepts.unionByName(hubs), papers, edges


_HOMES = "h AS (SELECT c_custkey AS k, c_name, c_mktsegment AS seg, CASE WHEN c_custkey % 3 IN (0, 1) THEN c_nationkey END AS nat FROM customer)"


@query(f"WITH {_HOMES} SELECT r_name AS label, count(*) AS papers FROM h JOIN nation ON nat = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def q27_topic_counts(spark, sf_dir):
    concepts, papers, edges = _library(spark, sf_dir)
    return library.topic_counts(concepts, papers, edges).select("label", "papers")


@query(f"""WITH {_HOMES}, s AS (SELECT n_name AS label, 'hub' || n_regionkey AS hub, nat, k FROM h JOIN nation ON nat = n_nationkey WHERE n_regionkey = 1 AND (contains(lower(n_name), '_1') OR contains(lower(c_name), '_1') OR contains(lower(seg), '_1'))),
g AS (SELECT 'n' || nat AS concept_id, label, hub, count(*) AS n FROM s GROUP BY 1, 2, 3)
SELECT row_number() OVER (ORDER BY n DESC, label) AS place, concept_id, label, hub, n FROM g""")
def q28_browse(spark, sf_dir):
    concepts, papers, edges = _library(spark, sf_dir)
    rows = library.browse(concepts, papers, edges, query=" _1 ", domain="r1")
    return rows.select(F.col("place").cast("long").alias("place"), "concept_id", "label", "hub", "n")


@query(f"""WITH {_HOMES}, u AS (SELECT count(*) AS n FROM h WHERE nat IS NULL AND contains(lower(seg), 'house')), s AS (SELECT nat, count(*) AS n FROM h WHERE nat IS NOT NULL AND contains(lower(seg), 'house') GROUP BY nat)
SELECT (SELECT count(*) FROM s) AS groups, CAST((SELECT sum(n) FROM s) + (SELECT n FROM u) AS BIGINT) AS papers""")
def q28b_browse_counts(spark, sf_dir):
    return library.browse_counts(library.browse(*_library(spark, sf_dir), query="HOUSE"))


@query("""WITH hubs AS (SELECT 'hub' || r_regionkey AS topic, r_name, row_number() OVER (ORDER BY 'hub' || r_regionkey) AS i FROM region),
p AS (SELECT ['#e0605a', '#5b93d6', '#a06cd5', '#45ac6d', '#29bccd', '#e6912e'] AS c)
SELECT 'n' || n_nationkey AS id, topic, r_name AS topic_label, c[i] AS color FROM nation JOIN hubs ON topic = 'hub' || n_regionkey, p
UNION ALL SELECT topic, topic, r_name, c[i] FROM hubs, p""")
def q29_topic_index(spark, sf_dir):
    concepts, _, edges = _library(spark, sf_dir)
    return library.topic_index(concepts, edges)


_DRAIN = """d AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS basis, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '1996-06-01T00:00:00' ELSE '2030-01-01T00:00:00' END AS written FROM orders)"""


def _orders(spark, sf_dir):
    k, at = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    none = F.lit(None).cast("string")
    written = F.when(k % 3 == 1, "1996-06-01T00:00:00").when(k % 3 == 2, "2030-01-01T00:00:00")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 2 == 0, at).otherwise("").alias("savedAt"), F.when(k % 2 == 1, at).alias("updatedAt"), none.alias("createdAt"), written.alias("vaultWrittenAt"), F.concat(F.lit("c"), "o_custkey").alias("conceptId")
    )


@query(f"WITH {_DRAIN} SELECT id, greatest('1997-01-01T00:00:00', basis) AS stamp FROM d WHERE written IS NULL OR written < basis")
def q36_drain(spark, sf_dir):
    return drain.stale(_orders(spark, sf_dir)).select("id", drain.stamp("1997-01-01T00:00:00").alias("stamp"))


@query("SELECT event_id AS id, ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS focus FROM events")
def q37_focus(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.agg(F.max("ts")).collect()[0][0]
    saved = events.select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("savedAt"))
    return library.focus_and_shelf(saved, F.lit(last)).select("id", "focus")


@query("""WITH c AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 2 ELSE 3 END AS i, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 10 ELSE 15 END AS o, l_quantity AS q, l_partkey AS p FROM lineitem)
SELECT count(*) AS calls, sum(q * 2 + p) AS input_tokens, sum(q) AS output_tokens, round(sum((q * i + (q + p) * i * 0.1 + q * o) / 1e6), 4) AS cost FROM c""")
def q46_usage(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").select(
        F.lit("m").alias("model"), F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_quantity").alias("input"), F.lit(0.0).alias("created"),
        (F.col("l_quantity") + F.col("l_partkey")).alias("cached"), F.col("l_quantity").alias("output"),
    )
    rates = spark.createDataFrame([("m", "1900-01-01", 2.0, 10.0), ("m", "1998-01-01", 3.0, 15.0)], "model string, valid_from string, input_rate double, output_rate double")
    return projects.usage(calls, rates.withColumn("valid_from", F.col("valid_from").cast("timestamp"))).withColumn("cost", F.round("cost", 4))


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS key, arg_max(props, ts) AS value FROM events GROUP BY 1, 2")
def q48_latest_write(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    writes = events.select(F.col("user_id").cast("string").alias("user_id"), F.lit("papers").alias("collection"), F.col("event_type").alias("key"), F.col("props").alias("value"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("updated_at"))
    return kv.latest_writes(writes).select("user_id", "key", "value")


@query("SELECT c_name AS key FROM customer ORDER BY c_name LIMIT 1000 OFFSET 1000")
def q49_second_page(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"))
    last = kv.page(rows).agg(F.max("key")).collect()[0][0]
    return kv.page(rows, after=last)


@query("""WITH base AS (SELECT CAST(user_id AS VARCHAR) AS u, event_type AS k, arg_max(props, ts) AS v FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1, 2),
new AS (SELECT CAST(user_id AS VARCHAR) AS u, event_type AS k, arg_max(props, ts) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2)
SELECT u AS user_id, k AS key, v AS value FROM new UNION ALL SELECT * FROM base WHERE (u, k) NOT IN (SELECT (u, k) FROM new)""")
def q48b_upsert(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.col("user_id").cast("string").alias("user_id"), F.lit("papers").alias("collection"), F.col("event_type").alias("key"), F.col("props").alias("value"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("updated_at"),
    )
    cut = "2024-01-10"
    return kv.upsert(kv.latest_writes(rows.where(F.col("updated_at") < cut)), rows.where(F.col("updated_at") >= cut)).select("user_id", "key", "value")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, floor((row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) - 1) / 200)::BIGINT AS batch FROM customer WHERE c_custkey % 7 <> 0""")
def q58_migration_batches(spark, sf_dir):
    k = F.col("c_custkey")
    value = F.when(k % 7 == 0, "{broken").otherwise(F.to_json(F.struct("c_name")))
    entries = table(spark, sf_dir, "customer").select(F.lit("papers").alias("collection"), k.alias("key"), value.alias("value"))
    local = entries.unionByName(spark.createDataFrame([("profile", 0, "{}"), ("nowhere", 0, "{}")], "collection string, key long, value string"))
    rows = kv.migration_rows(local, "u1", "2024").where("collection = 'papers'")
    return kv.batched(rows).select("key", F.col("batch").cast("long").alias("batch"))


@query("""SELECT p_partkey, '---' || chr(10) || 'title: ' || CASE WHEN regexp_matches(p_name, '^[A-Za-z0-9._-]+$') THEN p_name ELSE '"' || p_name || '"' END || chr(10) || 'tags: [' || CASE WHEN regexp_matches(p_type, '^[A-Za-z0-9._-]+$') THEN p_type ELSE '"' || p_type || '"' END || ', "Brand ' || p_size || '"]' || chr(10) || 'pdf:' || chr(10) || '---' AS head FROM part""")
def q59_frontmatter(spark, sf_dir):
    tags = F.array(F.col("p_type"), F.concat(F.lit("Brand "), "p_size"))
    head = render.frontmatter([("title", F.col("p_name"), False), ("tags", tags, True), ("pdf", F.lit(""), False)])
    return table(spark, sf_dir, "part").select("p_partkey", head.alias("head"))


@query("""SELECT o_orderkey, 'memos/' || strftime(o_orderdate, '%Y-%m-%d') || '-000000_memo.md' AS path, md5('---' || chr(10) || 'captured: "' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '"' || chr(10) || 'updated:' || chr(10) || '---' || chr(10) || chr(10)
 || '# Memo — ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || chr(10) || o_orderpriority || chr(10)) AS digest FROM orders""")
def q60_memo_notes(spark, sf_dir):
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    memos = table(spark, sf_dir, "orders").select("o_orderkey", at.alias("createdAt"), F.lit("").alias("updatedAt"), F.col("o_orderpriority").alias("text"))
    return memos.select("o_orderkey", render.memo_file(F.col("createdAt")).alias("path"), F.md5(render.memo_note().cast("binary")).alias("digest"))


@query("""WITH t AS (SELECT o_orderkey AS pos, [CAST(o_custkey AS VARCHAR), CAST(o_custkey + 1 AS VARCHAR), 'x', CAST(o_custkey AS VARCHAR)] AS p FROM orders),
u AS (SELECT pos, unnest(p[1:3]) AS pmid, unnest([0, 1, 2]) AS nr FROM t), k AS (SELECT CAST(c_custkey AS VARCHAR) AS pmid, c_custkey % 4 = 0 AS f FROM customer)
SELECT pos, string_agg(pmid, ',' ORDER BY nr) AS pmids FROM u JOIN k USING (pmid) GROUP BY pos HAVING bool_or(f)""")
def q61_weekend_threads(spark, sf_dir):
    k = F.col("o_custkey")
    cited = F.array(k.cast("string"), (k + 1).cast("string"), F.lit("x"), k.cast("string"))
    threads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.lit("a").alias("anchor"), cited.alias("pmids"), F.lit("").alias("narrative"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("pmid"), (F.col("c_custkey") % 4 == 0).alias("f"))
    return library.weekend_threads(threads, known.where("f"), known.where("NOT f")).select("pos", F.array_join("pmids", ",").alias("pmids"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%b ') || CAST(day(o_orderdate) AS VARCHAR) || CASE WHEN year(o_orderdate) = 1998 THEN '' ELSE ', ' || year(o_orderdate) END AS label FROM orders""")
def q62_day_label(spark, sf_dir):
    now = F.lit("1998-08-02").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", digests.day_label(F.col("o_orderdate").cast("timestamp"), now).alias("label"))
