"""Queries of text functions, lint and parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import render
from ..functions import text as X
from ..operators import domains, guard, projects
from ..sources import records
from .registry import query, table

# DuckDB's regular expressions have no look-around: candidates are cut out loosely, then checked whole
NORMAL = "lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))"
_TOKEN = "lambda x: regexp_extract(x, '^(-?(?:[0-9]+\\.[0-9]+|\\.[0-9]+|[0-9]+))(?:\\.(?:\\..*)?)?$', 1)"
LOOSE = "regexp_extract_all({t}, '(^|[^0-9.])(-?[0-9.]+)', {g})"


def tokens_sql(t: str) -> str:
    return f"list_filter(list_transform({LOOSE.format(t=t, g=2)}, {_TOKEN}), lambda x: x <> '')"


def _normal(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("t"))


@query(f"""WITH d AS (SELECT doc_id, {tokens_sql(NORMAL)} AS tokens FROM documents)
SELECT doc_id, unnest(range(len(tokens))) AS ord, unnest(tokens) AS token FROM d""")
def q05_number_tokens(spark, sf_dir):
    return _normal(spark, sf_dir).select("doc_id", F.posexplode(X.number_strings(F.col("t"))).alias("ord", "token")).withColumn("ord", F.col("ord").cast("long"))


@query(f"""SELECT doc_id, length({NORMAL}) AS n, md5({NORMAL}) AS digest FROM documents""")
def q06_normalized(spark, sf_dir):
    rows = X.normalize_frame(table(spark, sf_dir, "documents"), t="text")
    return rows.select("doc_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


#: Letters and digits in a block of a text.
BLOCK = 24
MOST_SHORT = 10_000
_B = "SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q FROM benchmark"


@query(f"""WITH b AS ({_B}), d AS (SELECT doc_id, {NORMAL} AS t FROM documents)
SELECT doc_id, item_id, strpos(t, q) - 1 AS at, length(q) AS len FROM d JOIN b ON contains(t, q)""")
def q07_locate_exact(spark, sf_dir):
    found = _located(spark, sf_dir).where(F.col("m.found") & ~F.col("m.fuzzy"))
    return found.select("doc_id", "item_id", F.col("m.index").cast("long").alias("at"), F.col("m.length").cast("long").alias("len"))


def _located(spark, sf_dir):
    """Passages and the documents that have their letters and digits. A text is cut into blocks; a passage
    of two blocks' length that it has covers one of them whole, so blocks are joined with the passages'
    windows, and only those pairs, and shorter passages, are compared."""
    b = table(spark, sf_dir, "benchmark").select("item_id", X.normalize(F.col("text")).alias("q")).withColumn("bare_q", X.alnum(F.col("q")))
    d = table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("t")).withColumn("bare", X.alnum(F.col("t")))
    long = F.length("bare_q") >= 2 * BLOCK - 1
    starts = F.sequence(F.lit(1), F.length("bare_q") - BLOCK + 1)
    windows = b.where(long).select("item_id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("bare_q"), i, F.lit(BLOCK))))).alias("block"))
    blocks = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("bare", F.lit(f"[a-z0-9]{{{BLOCK}}}"), F.lit(0)))).alias("block"))
    pairs = blocks.join(windows, "block").select("doc_id", "item_id").distinct()
    met = d.join(pairs, "doc_id").join(b, "item_id")
    short = b.where(~long)
    # few are sent to every task; of more the planner sees to it, by a broadcast if they are small or a product
    few = short.limit(MOST_SHORT + 1).count() <= MOST_SHORT
    met = met.select("doc_id", "item_id", "q", "t", "bare", "bare_q").unionByName(d.join(F.broadcast(short) if few else short, F.contains("bare", "bare_q")).select("doc_id", "item_id", "q", "t", "bare", "bare_q"))
    return met.where(F.contains("bare", "bare_q")).select("doc_id", "item_id", X.locate(F.col("q"), F.col("t")).alias("m"))


@query(f"""WITH b AS ({_B}), d AS (SELECT doc_id, {NORMAL} AS t FROM documents),
p AS (SELECT doc_id, item_id, t, q, regexp_replace(t, '[^a-z0-9]', '', 'g') AS bt, regexp_replace(q, '[^a-z0-9]', '', 'g') AS bq FROM d, b)
SELECT doc_id, item_id, NOT contains(t, q) AS fuzzy FROM p WHERE contains(t, q) OR (length(bq) > 6 AND contains(bt, bq))""")
def q08_locate_fuzzy(spark, sf_dir):
    return _located(spark, sf_dir).where("m.found").select("doc_id", "item_id", F.col("m.fuzzy").alias("fuzzy"))


@query(f"""WITH d AS (SELECT doc_id, {LOOSE.format(t=NORMAL, g=1)} AS pre, list_transform({LOOSE.format(t=NORMAL, g=2)}, {_TOKEN}) AS tok FROM documents),
x AS (SELECT doc_id, unnest(pre) AS pre, unnest(tok) AS tok FROM d)
SELECT documents.doc_id, coalesce(bool_and(tok = '' OR regexp_matches(pre, '[A-Za-z]') OR TRY_CAST(tok AS DOUBLE) IN (1.0, 2.0, 3.0)), TRUE) AS grounded
FROM documents LEFT JOIN x USING (doc_id) GROUP BY documents.doc_id""")
def q18b_grounded(spark, sf_dir):
    allowed = guard.allowed_numbers(F.array(F.lit("1 of 2"), F.lit("3.0%")))
    return table(spark, sf_dir, "documents").select("doc_id", guard.numbers_grounded(F.col("text"), allowed).alias("grounded"))


@query()
def q18c_strip_numbers(spark, sf_dir):
    """What is taken out depends on look-behind, which DuckDB's expressions lack; the tests hold it against
    Python's."""
    return table(spark, sf_dir, "documents").select("doc_id", guard.strip_numbers(F.col("text")).alias("text"))


def stems_sql(text: str, source: str, key: str) -> str:
    """key, stem, word, pos: the first of each telling stem."""
    cases = " ".join(f"WHEN ends_with(w, '{s}') AND length(w) - {len(s)} >= 4 THEN substring(w, 1, length(w) - {len(s)})" for s in X.STEM_SUFFIXES)
    stops = ", ".join(f"'{s}'" for s in sorted({X._stem(w) for w in X.STOPWORDS}))
    return f"""(SELECT {key}, stem, min(pos) AS pos, arg_min(w, pos) AS word FROM (
      SELECT {key}, w, pos, CASE {cases} ELSE w END AS stem FROM (
        SELECT {key}, unnest(parts) AS w, generate_subscripts(parts, 1) AS pos FROM (
          SELECT {key}, string_split(regexp_replace(regexp_replace(lower({text}), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' ') AS parts FROM {source}))
      WHERE length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$'))
    WHERE stem NOT IN ({stops}) GROUP BY {key}, stem)"""


@query(f"""SELECT doc_id, count(*) AS n, md5(string_agg(stem || ':' || word, ',' ORDER BY pos)) AS digest FROM {stems_sql("text", "documents", "doc_id")} GROUP BY doc_id""")
def q19_stems(spark, sf_dir):
    found = X.significant_tokens(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", found.alias("s")).where(F.size("s") > 0)
    joined = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["stem"], x["word"])), ",")
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(joined.cast("binary")).alias("digest"))


@query("""SELECT n_nationkey AS k, 'concept:' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') AS concept,
 substring(trim(regexp_replace(lower(n_name || ' & co'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 0) || trim(regexp_replace(regexp_replace(lower(n_name || ' & co'), '&', ' and ', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS domain,
 replace(lower(n_name), '_', '') || 'co' AS name FROM nation""")
def q39_slugs(spark, sf_dir):
    label = F.concat("n_name", F.lit(" & co"))
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("k"), X.concept_id(F.col("n_name")).alias("concept"), X.domain_slug(label).alias("domain"), X.domain_name(label).alias("name")
    )


@query("""WITH d AS (SELECT lower(s) AS key, s AS label, row_number() OVER (ORDER BY s) AS pos FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)),
w AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment WHEN 2 THEN substring(c_mktsegment, 1, 3) || '-' || substring(c_mktsegment, 4) ELSE 'unknown ' || c_mktsegment END AS raw FROM customer)
SELECT c_custkey, raw, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE replace(lower(raw), '-', '') END AS key FROM w""")
def q40_match_domains(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    seg, k = F.col("c_mktsegment"), F.col("c_custkey") % 4
    raw = F.when(k == 0, F.lower(seg)).when(k == 1, seg).when(k == 2, F.concat(F.substring(seg, 1, 3), F.lit("-"), F.substring(seg, 4, 20))).otherwise(F.concat(F.lit("unknown "), seg))
    known = customer.select(seg.alias("label")).distinct().select(F.lower("label").alias("key"), "label", F.ascii("label").alias("pos"))
    return domains.match_domains(customer.select("c_custkey", raw.alias("raw")), known).select("c_custkey", "raw", "key")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'undated' ELSE '2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') END || '_' ||
 CASE WHEN p_partkey % 5 = 0 THEN 'pmid-' || p_partkey ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') END AS slug FROM part""")
def q41_source_slug(spark, sf_dir):
    k = F.col("p_partkey")
    saved = F.when(k % 3 != 0, F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T08:00:00Z"))).otherwise("today")
    title = F.when(k % 5 != 0, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", render.source_slug(saved, title, k.cast("string")).alias("slug"))


@query("""SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') UNION SELECT p_partkey FROM part WHERE contains(lower(p_type), 'red') OR contains(lower(p_brand), 'red')""")
def q42_search(spark, sf_dir):
    from ..operators import library

    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("finding"), F.lit(None).cast("string").alias("notes"), F.array("p_brand").alias("tags"))
    return rows.where(library.paper_matches(F.lit("red"))).select("p_partkey")


_RAW = """CASE page_id % 5 WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || page_id || '/' WHEN 2 THEN 'see pmc' || page_id || ' there'
 WHEN 3 THEN 'doi: 10.' || (1000 + page_id) || '/abc.' || page_id || ').' ELSE url END"""


@query(f"""WITH r AS (SELECT page_id, {_RAW} AS raw FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pmid' WHEN 1 THEN 'pmid' WHEN 2 THEN 'pmcid' WHEN 3 THEN 'doi' END AS kind,
 CASE page_id % 5 WHEN 0 THEN raw WHEN 1 THEN CAST(page_id AS VARCHAR) WHEN 2 THEN 'PMC' || page_id WHEN 3 THEN '10.' || (1000 + page_id) || '/abc.' || page_id END AS value FROM r""")
def q43_identifiers(spark, sf_dir):
    raw = F.expr(_RAW.replace("VARCHAR", "STRING"))
    rows = table(spark, sf_dir, "pages").select("page_id", records.resolve_identifier(raw).alias("r"))
    return rows.select("page_id", F.col("r.kind").alias("kind"), F.col("r.value").alias("value"))


@query("""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages""")
def q44_node_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(records.node_text(F.col("html")).cast("binary")).alias("digest"))


_Q = """CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', ' OR ') WHEN 2 THEN 'a AND b AND ' || text || ' [tiab]' ELSE '' END"""


@query(f"""WITH r AS (SELECT conv_id, turn, trim({_Q}) AS q FROM conversations),
c AS (SELECT *, len(regexp_extract_all(q, '\\bAND\\b')) AS ands,
 list_max(list_transform(regexp_split_to_array(q, '\\bOR\\b'), lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '' AND NOT regexp_matches(lower(w), '^(and|or|not)$'))))) AS run FROM r)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN q = '' THEN 'empty' END, CASE WHEN q <> '' AND ands >= 2 THEN 'and-chain' END, CASE WHEN q <> '' AND run >= 5 THEN 'juxtaposed' END,
 CASE WHEN q <> '' AND regexp_matches(q, '\\[[^\\]]*\\]') THEN 'field-tag' END, CASE WHEN q <> '' AND NOT regexp_matches(q, '\\s') THEN 'bare-word' END], lambda x: x IS NOT NULL), ',') AS codes FROM c""")
def q45_lint(spark, sf_dir):
    issues = projects.topic_issues(F.expr(_Q))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(issues, lambda i: i["code"]), ",").alias("codes"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def q47_json(spark, sf_dir):
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, sf_dir, "events").select("event_id", value.alias("k"))


@query("""SELECT doc_id, CASE WHEN length(t) <= 140 THEN t ELSE regexp_replace(CASE WHEN strpos(reverse(substring(t, 1, 140)), ' ') > 0 AND 140 - strpos(reverse(substring(t, 1, 140)), ' ') > 70
  THEN substring(t, 1, 140 - strpos(reverse(substring(t, 1, 140)), ' ')) ELSE substring(t, 1, 140) END, '\\s+$', '') || '…' END AS short
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")
def q52_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate(X.collapse(F.col("text"))).alias("short"))


@query()
def q53_hash01(spark, sf_dir):
    """A 32-bit multiplicative hash; SQL's integers would overflow differently, so plain Python checks it."""
    return table(spark, sf_dir, "part").select("p_partkey", X.hash01(F.concat("p_name", F.lit(":"), "p_partkey")).alias("h"))
