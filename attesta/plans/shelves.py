"""Queries of saving, deleting and filing papers, of what a digest shows, and of edits to a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import domains, funnel, graph, kv, library, projects, shelving, topics
from .libraries import _library
from .registry import query, table


def _null():
    return F.lit(None).cast("string")


def _nodes(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The concepts, papers and edges of ``libraries._library`` with the columns that edits need."""
    concepts, papers, edges = _library(spark, sf_dir)
    nodes = concepts.select("*", F.lit("concept").alias("kind"), F.lit("2023").alias("addedAt"), F.lit("2023").alias("updatedAt"))
    return nodes, papers, edges


_FILED = """f AS (SELECT c_custkey AS k, c_nationkey AS nat, CASE WHEN c_custkey % 3 = 0 THEN 'n' || c_nationkey END AS concept, c_custkey % 3 = 1 AS cited FROM customer)"""


@query(f"""WITH {_FILED}, gone AS (SELECT n_nationkey AS nat FROM nation WHERE n_regionkey IN (0, 3))
SELECT 'paper ' || k AS what, CASE WHEN nat IN (SELECT nat FROM gone) THEN NULL ELSE concept END AS value FROM f
UNION ALL SELECT 'node n' || n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT nat FROM gone)
UNION ALL SELECT 'node hub' || r_regionkey, r_name FROM region
UNION ALL SELECT 'edge n' || n_nationkey, 'hub' || n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT nat FROM gone)""")
def q71_delete_concepts(spark, sf_dir):
    """The nations of two regions are deleted, and a hub, which stays."""
    nodes, papers, edges = _nodes(spark, sf_dir)
    gone = table(spark, sf_dir, "nation").where("n_regionkey IN (0, 3)").select(F.concat(F.lit("n"), "n_nationkey").alias("id"))
    left, kept, links = shelving.delete_concepts(papers, nodes, edges, gone.unionByName(nodes.where("id = 'hub1'").select("id")))
    row = lambda kind, id, value: (F.concat(F.lit(kind), id).alias("what"), F.col(value).alias("value"))
    return left.select(*row("paper ", "id", "conceptId")).unionByName(kept.select(*row("node ", "id", "label"))).unionByName(links.select(*row("edge ", "source", "target")))


@query(f"""WITH {_FILED}
SELECT 'paper ' || k AS what, 1 AS n FROM f WHERE k % 4 <> 1
UNION ALL SELECT 'node n' || n_nationkey, (SELECT count(*) FROM f WHERE nat = n_nationkey AND cited AND k % 4 <> 1) FROM nation
UNION ALL SELECT 'node hub' || r_regionkey, 0 FROM region""")
def q72_delete_papers(spark, sf_dir):
    nodes, papers, _ = _nodes(spark, sf_dir)
    left, kept = shelving.delete_papers(papers, nodes, papers.where(F.col("id").cast("long") % 4 == 1).select("id"))
    one = left.select(F.concat(F.lit("paper "), "id").alias("what"), F.lit(1).cast("long").alias("n"))
    return one.unionByName(kept.select(F.concat(F.lit("node "), "id").alias("what"), F.size("sourcePmids").cast("long").alias("n")))


def _hearts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers up to a third of all are saved, every second one with a heart; every fifth is a record of
    a run, of these every third retracted."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, k.cast("string").alias("id"), F.col("c_name").alias("title"), F.when(k % 4 != 0, k % 2 == 0).alias("favorite"), (k % 3 == 0).alias("retracted"))
    return rows.where(k % 3 == 1).drop("c_custkey"), rows.where(k % 5 == 0).drop("c_custkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE (c_custkey % 3 = 1 AND c_custkey % 5 <> 0) OR (c_custkey % 3 = 2 AND c_custkey % 5 = 0)")
def q73_toggle_saved(spark, sf_dir):
    return shelving.toggle_saved(*_hearts(spark, sf_dir)).select("id")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 3 = 2 OR NOT coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 2 = 0 END, FALSE)
  ELSE CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 2 = 0 END END AS favorite FROM customer WHERE c_custkey % 3 = 1 OR (c_custkey % 3 = 2 AND c_custkey % 5 = 0)""")
def q74_favorite(spark, sf_dir):
    return shelving.favorite(*_hearts(spark, sf_dir)).select("id", "favorite")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'old' WHEN c_custkey % 5 = 0 THEN NULL WHEN c_nationkey % 3 = 0 THEN 'pdf' || c_nationkey END AS pdf,
 CASE WHEN c_custkey % 4 = 0 OR c_custkey % 5 = 0 THEN NULL WHEN c_nationkey % 3 = 1 THEN 'page' || c_nationkey END AS page FROM customer""")
def q75_fill_links(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    doi = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("d"), "c_nationkey"))
    papers = table(spark, sf_dir, "customer").select(k.alias("id"), F.struct(doi.alias("doi")).alias("citation"), F.when(k % 4 == 0, "old").alias("pdfUrl"), _null().alias("oaUrl"))
    resolved = table(spark, sf_dir, "nation").select(F.concat(F.lit("d"), n).alias("doi"), F.when(n % 3 == 0, F.concat(F.lit("pdf"), n)).otherwise("").alias("pdf"), F.when(n % 3 != 2, F.concat(F.lit("page"), n)).alias("landing"))
    return shelving.fill_links(papers, resolved).select("id", F.col("pdfUrl").alias("pdf"), F.col("oaUrl").alias("page"))


@query("""SELECT 'hub' || r_regionkey AS what FROM region UNION ALL SELECT 'paper' || c_custkey FROM customer""")
def q76_reset_filing(spark, sf_dir):
    nodes, papers, edges = _nodes(spark, sf_dir)
    bare, left, links = shelving.reset_filing(papers, nodes, edges, "2024")
    free = bare.where("conceptId IS NULL AND domain IS NULL").select(F.concat(F.lit("paper"), "id").alias("what"))
    return free.unionByName(left.where("size(sourcePmids) = 0").select(F.col("id").alias("what"))).unionByName(links.select(F.col("source").alias("what")))


@query("""WITH f AS (SELECT c_custkey AS k, c_nationkey AS nat, c_mktsegment AS seg FROM customer),
c AS (SELECT 'concept:' || lower(seg) AS id, count(*) AS n, 'hub' || min(nat % 5) AS hub FROM f GROUP BY seg)
SELECT id AS what, CAST(n AS VARCHAR) AS value FROM c
UNION ALL SELECT 'paper' || k, 'concept:' || lower(seg) FROM f
UNION ALL SELECT least(id, hub) || '~~' || greatest(id, hub), 'confirmed' FROM (SELECT id, 'hub' || arg_min(nat % 5, CAST(k AS VARCHAR)) AS hub FROM f JOIN c ON id = 'concept:' || lower(seg) GROUP BY id)""")
def q77_file_under(spark, sf_dir):
    """Customers filed by market segment under the region's hub that the first of them names."""
    nodes, papers, edges = _nodes(spark, sf_dir)
    hubs = nodes.where("isHub")
    where = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("pmid"), F.col("c_mktsegment").alias("concept"), F.concat(F.lit("hub"), F.col("c_nationkey") % 5).alias("hub_id"))
    filings = where.select("*", X.concept_id(F.col("concept")).alias("concept_id"), F.lit("").alias("domain"), F.array(F.lit("t")).alias("tags"))
    none = edges.limit(0).select(_null().alias("id"), "source", "target", "origin", _null().alias("status"))
    after, merged, links = shelving.file_under(papers, hubs, none, filings, "2024")
    concepts = merged.where("NOT isHub").select(F.col("id").alias("what"), F.size("sourcePmids").cast("string").alias("value"))
    filed = after.select(F.concat(F.lit("paper"), "id").alias("what"), F.col("conceptId").alias("value"))
    return concepts.unionByName(filed).unionByName(links.select(F.col("id").alias("what"), F.col("status").alias("value")))


_SHOWN = """r AS (SELECT doc_id AS id, doc_id % 9 = 0 AS failed, doc_id % 11 = 0 AS retracted FROM documents),
s AS (SELECT doc_id AS id, max(coalesce(quality, 0) * 50 + coalesce(toxic, 0) * 10 + doc_id % 7) AS score FROM labels GROUP BY doc_id)"""


def _shown(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as results, some failed or retracted; labelled ones have a score."""
    id = F.col("doc_id")
    results = table(spark, sf_dir, "documents").select(id.alias("id"), id.alias("idx"), F.when(id % 9 == 0, "failed").alias("error"), (id % 11 == 0).alias("retracted"))
    score = F.coalesce("quality", F.lit(0)) * 50 + F.coalesce("toxic", F.lit(0)) * 10 + id % 7
    return results, table(spark, sf_dir, "labels").select(id.alias("id"), score.cast("string").alias("score"))


@query(f"WITH {_SHOWN} SELECT r.id, row_number() OVER (ORDER BY coalesce(score, -1) DESC, r.id) AS place FROM r LEFT JOIN s USING (id)")
def q78_digest_order(spark, sf_dir):
    return funnel.digest_order(*_shown(spark, sf_dir)).select("id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_SHOWN}, k AS (SELECT r.id, failed FROM r LEFT JOIN s USING (id) WHERE NOT retracted AND (failed OR coalesce(score >= 52, FALSE))),
a AS (SELECT id, 0 AS g, failed FROM k UNION ALL SELECT id, 1, FALSE FROM r WHERE id % 5 = 0 AND NOT failed AND NOT retracted AND id NOT IN (SELECT id FROM k))
SELECT id, row_number() OVER (ORDER BY g, failed, id) AS place FROM a""")
def q79_forced_inclusion(spark, sf_dir):
    results, rankings = _shown(spark, sf_dir)
    shown = funnel.post_read_floor(results, rankings, 52)
    return funnel.with_forced(shown, results, results.where("id % 5 = 0")).select("id", F.col("place").cast("long").alias("place"))


@query("""SELECT c_custkey AS id, row_number() OVER (ORDER BY c_name, c_custkey) AS place FROM customer""")
def q80_titles(spark, sf_dir):
    """Names are equally long and differ in digits, so a dictionary's order is the one of their bytes."""
    from pyspark.sql import Window as W

    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return library.by_title(papers).select("id", F.row_number().over(W.orderBy(F.collate("title", "UNICODE"), "id")).cast("long").alias("place"))


_PROFILES = """t AS (SELECT p_partkey AS pos, 'u' || (p_partkey % 50) AS l, p_partkey % 50 AS u, p_name AS q FROM part)"""


@query(f"""WITH {_PROFILES}, own AS (SELECT * FROM t WHERE u % 3 = 0), star AS (SELECT * FROM t WHERE u % 3 = 1),
s AS (SELECT l, q, pos, row_number() OVER (PARTITION BY l, lower(q) ORDER BY pos) AS n FROM (SELECT * FROM own UNION ALL SELECT * FROM star))
SELECT l AS list_id, q AS query FROM s WHERE n = 1 UNION ALL SELECT DISTINCT l, 'vascular surgery' FROM t WHERE u % 3 = 2""")
def q81_profile_topics(spark, sf_dir):
    """One profile in three has topics and interests, one interests only, one nothing."""
    u = F.col("p_partkey") % 50
    t = table(spark, sf_dir, "part").select(F.concat(F.lit("u"), u).alias("list_id"), u.alias("u"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("star"))
    raw = t.where("u % 3 = 0").select("list_id", "pos", F.col("star").alias("query"), *(_null().alias(n) for n in ("label", "topic", "name", "term", "q", "text")))
    return topics.profile_topics(t.select("list_id"), raw, t.where("u % 3 < 2")).select("list_id", "query")


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'a=x;b=' || c_name WHEN 1 THEN 'a=x' ELSE 'a=x;b=y;=' END AS rows FROM customer""")
def q82_topic_rows(spark, sf_dir):
    k = F.col("c_custkey")
    topic = lambda label, q: F.struct(F.lit(label).alias("label"), F.lit(q).alias("query"))
    rows = F.array(topic("a", "x"), topic("b", "y"))
    edited = F.when(k % 3 == 0, topics.set_row(rows, F.lit(1), query=F.col("c_name"))).when(k % 3 == 1, topics.remove_row(rows, F.lit(1))).otherwise(topics.add_row(rows))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.array_join(F.transform(edited, lambda t: F.concat(t["label"], F.lit("="), t["query"])), ";").alias("rows"))


@query("""SELECT s_suppkey AS user_id, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 7 ELSE 5 END AS n, 'c' AS criteria FROM supplier""")
def q83_merge_profile(spark, sf_dir):
    k = F.col("s_suppkey")
    rubric = lambda n, c: F.struct(n.alias("selectCount"), c.alias("criteria"))
    base = table(spark, sf_dir, "supplier").select(k.alias("user_id"), F.col("s_name").alias("name"), rubric(F.lit(5), F.lit("c")).alias("rubric"))
    patch = table(spark, sf_dir, "supplier").where(k % 2 == 0).select(k.alias("user_id"), F.lit("new").alias("name"), rubric(F.when(k % 3 == 0, 7), _null()).alias("rubric"))
    return projects.merge_profile(base, patch, fields=("name",)).select("user_id", "name", F.col("rubric.selectCount").cast("long").alias("n"), "rubric.criteria")


@query("""SELECT c_custkey AS id, c_name || ' (' || n_name || ')' || CASE WHEN c_custkey % 4 = 0 THEN ', due 2024-05-06' ELSE '' END || ' — ' || c_mktsegment AS line FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE n_nationkey < 7 AND c_custkey % 5 <> 0""")
def q84_project_lines(spark, sf_dir):
    k = F.col("c_custkey")
    made = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_name").alias("title"), F.concat(F.lit(" "), "c_mktsegment").alias("description"), F.when(k % 4 == 0, "2024-05-06T10:00").alias("deadline_at"), _null().alias("updated_at"),
        F.when(k % 5 == 0, "gone").alias("deleted_at"), F.col("c_nationkey").alias("current_stage_id"),
    )
    stages = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("position"))
    return projects.pre_submission(projects.with_stages(made, stages)).select("id", projects.project_line().alias("line"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN coalesce('d' || (nullif(c_nationkey, 3) + 1), 'd3') ELSE 'd' || c_nationkey END AS domain FROM customer""")
def q85_repoint(spark, sf_dir):
    k = F.col("c_custkey")
    key = lambda n: F.concat(F.when(k % 4 == 0, "x").otherwise("d"), n)
    papers = table(spark, sf_dir, "customer").select(k.alias("id"), key(F.col("c_nationkey")).alias("domain"))
    n = F.col("n_nationkey")
    merges = table(spark, sf_dir, "nation").select(F.concat(F.lit("x"), n).alias("from"), F.concat(F.lit("d"), F.when(n == 3, 3).otherwise(n + 1)).alias("into"))
    return domains.repoint(papers, merges)


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey < 10 THEN n_name WHEN c_nationkey = 10 THEN 'Surgical Education' ELSE 'Unclassified' END AS label,
 CASE WHEN c_nationkey < 10 THEN '#' || c_nationkey WHEN c_nationkey = 10 THEN '#a06cd5' ELSE '#6fa8ff' END AS color FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q86_domain_labels(spark, sf_dir):
    n = F.col("c_nationkey")
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(n == 10, "education").otherwise(F.concat(F.lit("d"), n)).alias("domain"))
    known = table(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.concat(F.lit("d"), "n_nationkey").alias("key"), F.col("n_name").alias("label"), F.concat(F.lit("#"), "n_nationkey").alias("color"))
    return domains.with_labels(papers, known).select("id", F.col("domain_label").alias("label"), F.col("domain_color").alias("color"))


_GRAPH = """e AS (SELECT s_suppkey AS i, 's' || s_suppkey AS a, 'n' || s_nationkey AS b, s_suppkey % 2 = 0 AS sure FROM supplier)"""


def _supply(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    source, target = F.concat(F.lit("s"), k), F.concat(F.lit("n"), "s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        X.edge_id(source, target).alias("id"), source.alias("source"), target.alias("target"), F.when(k % 2 == 0, "confirmed").otherwise("proposed").alias("status"), F.lit("llm").alias("origin"),
        F.lit("r").alias("rationale"), F.lit("2023").alias("ts"), F.when(k % 2 == 0, "2023").alias("confirmedAt"),
    )


@query(f"WITH {_GRAPH} SELECT b || '~~' || a AS id, CASE WHEN sure THEN '2023' ELSE '2024' END AS at FROM e")
def q87_confirm_all(spark, sf_dir):
    return graph.confirm_all(_supply(spark, sf_dir), "2024").where("status = 'confirmed'").select("id", F.col("confirmedAt").alias("at"))


@query(f"WITH {_GRAPH} SELECT a AS id FROM e WHERE b = 'n7'")
def q88_neighbours(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return graph.neighbours(nodes, _supply(spark, sf_dir), "n7").select("id")


@query(f"WITH {_GRAPH}, d AS (SELECT b, count(*) AS n FROM e GROUP BY b UNION ALL SELECT a, 1 FROM e) SELECT n AS floor FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS r FROM d) WHERE r = 5")
def q89_label_floor(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    nodes = supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id")).unionByName(supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("id")).distinct()).withColumn("kind", F.lit("concept"))
    return graph.label_floor(nodes, _supply(spark, sf_dir), 5).select(F.col("floor").cast("long").alias("floor"))


@query(f"WITH {_FILED} SELECT CAST(k AS VARCHAR) AS id, CASE WHEN concept IS NOT NULL THEN concept WHEN cited THEN 'n' || nat END AS home FROM f")
def q90_paper_homes(spark, sf_dir):
    nodes, papers, _ = _nodes(spark, sf_dir)
    return library.paper_homes(papers, nodes).select("id", "home")


@query(f"WITH {_FILED} SELECT 'n' || nat AS concept_id, CAST(k AS VARCHAR) AS paper_id FROM f WHERE cited OR concept IS NOT NULL")
def q91_members(spark, sf_dir):
    nodes, papers, _ = _nodes(spark, sf_dir)
    return library.members(papers, nodes)


@query("SELECT count(*) AS total, count(*) FILTER (c_custkey % 3 <> 0) AS verified, count(*) FILTER (c_custkey % 3 = 1) AS flagged FROM customer")
def q92_rail_counts(spark, sf_dir):
    k = F.col("c_custkey")
    return library.rail_counts(table(spark, sf_dir, "customer").select(F.when(k % 3 == 1, "flagged").when(k % 3 == 2, "verified-full-text").alias("tier")))


@query("""SELECT 'u' || user_id AS user_id, event_id AS key FROM events WHERE user_id <> 7 AND NOT (event_type = 'view' AND event_id % 2 = 0)""")
def q93_store_deletes(spark, sf_dir):
    """A key of a collection is deleted, and one user starts over."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("user_id"), F.col("event_type").alias("collection"), F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("key"), "event_id")
    return kv.clear_user(kv.delete(rows, "view", "even"), "u7").select("user_id", F.col("event_id").alias("key"))
