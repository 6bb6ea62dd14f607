"""Queries of the verification gate, retractions and parsed records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import quantities as Q
from ..functions import text as X
from ..operators import retractions, verify
from ..sources import records
from .registry import query, table
from .texts import NORMAL, tokens_sql

_CLAIMS = f"""c AS (SELECT doc_id, tok, CAST(tok[1] AS DOUBLE) AS v0, CASE WHEN doc_id % 3 = 0 THEN CAST(tok[1] AS DOUBLE) + 0.1 ELSE CAST(tok[1] AS DOUBLE) END AS v
  FROM (SELECT doc_id, {tokens_sql(NORMAL)} AS tok FROM documents) WHERE len(tok) > 0)"""


def _claims(spark, sf_dir) -> DataFrame:
    """For each document with numbers a claim of the first, in one of three off by 0.1; the quote is the
    whole text."""
    documents = table(spark, sf_dir, "documents").withColumn("t", X.normalize(F.col("text")))
    tokens = X.number_strings(F.col("t"))
    value = F.get(tokens, F.lit(0)).cast("double") + F.when(F.col("doc_id") % 3 == 0, 0.1).otherwise(0.0)
    none = lambda t: F.lit(None).cast(t)
    quantity = F.struct(
        F.lit("first number").alias("name"), value.alias("value"), none("string").alias("unit"), none("double").alias("ci_low"), none("double").alias("ci_high"), none("double").alias("p_value"),
        F.col("text").alias("source_quote"), F.lit("prose").alias("location_hint"),
    )
    tier = F.when(F.col("doc_id") % 2 == 0, "abstract_only").otherwise("full_text")
    registry = none(schemas.CLAIM.rpartition("registry ")[2])
    return documents.where(F.size(tokens) > 0).select(F.col("doc_id").alias("claim_id"), quantity.alias("quantity"), F.col("text"), F.lit("").alias("tables"), tier.alias("source_tier"), registry.alias("registry"))


@query(f"""WITH {_CLAIMS}
SELECT doc_id AS claim_id, CASE WHEN NOT ok THEN 'flagged' WHEN doc_id % 2 = 0 THEN 'abstract-only' ELSE 'verified-full-text' END AS tier, ok AS consistent
FROM (SELECT doc_id, len(list_filter(tok, lambda x: abs(CAST(x AS DOUBLE) - v) <= 1e-9 * greatest(1, abs(v), abs(CAST(x AS DOUBLE))))) > 0 AS ok FROM c)""")
def q09_verify(spark, sf_dir):
    return verify.verify(_claims(spark, sf_dir)).select("claim_id", F.col("verdict.tier").alias("tier"), F.col("verdict.consistent").alias("consistent"))


@query(f"""WITH {_CLAIMS}, ok AS (SELECT * FROM c WHERE len(list_filter(tok, lambda x: abs(CAST(x AS DOUBLE) - v) <= 1e-9 * greatest(1, abs(v), abs(CAST(x AS DOUBLE))))) > 0)
SELECT doc_id AS claim_id, coalesce(list_filter(list_transform(range(1, 51), lambda k: round(v + k * 0.1, 6)), lambda x: len(list_filter(tok, lambda n: abs(CAST(n AS DOUBLE) - x) <= 1e-9 * greatest(1, abs(x), abs(CAST(n AS DOUBLE))))) = 0)[1], round(v * 1.7 + 0.13, 6))::REAL AS value, 'flagged' AS tier FROM ok""")
def q10_corrupt(spark, sf_dir):
    """What passed, with a value that isn't there: every one must be flagged."""
    passed = verify.verify(_claims(spark, sf_dir))
    again = verify.corrupt_and_reverify(passed)
    return again.select("claim_id", F.col("quantity.value").cast("float").alias("value"), F.col("verdict.tier").alias("tier"))


@query("""SELECT p_partkey, array_to_string(list_filter([
  CASE WHEN p_size % 10 = 0 THEN 'zero-p-value' END, CASE WHEN p_size % 10 IN (8, 9) AND p_size % 10 <> 0 THEN 'impossible-p-value' END,
  CASE WHEN p_partkey % 5 = 0 THEN 'reversed-confidence-interval' WHEN p_partkey % 5 = 1 THEN 'estimate-outside-confidence-interval' END,
  CASE WHEN p_partkey % 2 = 0 THEN 'percentage-over-100' END], lambda x: x IS NOT NULL), ',') AS kinds FROM part""")
def q63_plausibility(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    low = F.when(k % 5 == 0, 900.0).when(k % 5 == 1, 1.0).otherwise(0.0).cast("double")
    high = F.when(k % 5 == 1, 2.0).otherwise(F.when(k % 5 == 0, 1.0).otherwise(1e6)).cast("double")
    p = F.when(s % 10 >= 8, (s % 10).cast("double")).otherwise((s % 10) / F.lit(100.0))
    q = F.struct(
        F.lit("x").alias("name"), F.col("p_retailprice").alias("value"), F.when(k % 2 == 0, " percent ").alias("unit"), low.alias("ci_low"), high.alias("ci_high"), p.alias("p_value"), F.lit("").alias("source_quote"), F.lit("").alias("location_hint")
    )
    warnings = table(spark, sf_dir, "part").select("p_partkey", Q.plausibility_warnings(q, F.lit(True)).alias("w"))
    return warnings.select("p_partkey", F.array_join(F.transform("w", lambda w: w["kind"]), ",").alias("kinds"))


@query("""SELECT p_partkey, 'HR 1' || '·' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS quote, '1·' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ' (CI 0.50–2.00), P' || CASE p_partkey % 3 WHEN 0 THEN '<' WHEN 1 THEN '≥' ELSE '=' END || '0.05' AS shown FROM part""")
def q64_printed(spark, sf_dir):
    k = F.col("p_partkey")
    digits = F.lpad(F.col("p_size").cast("string"), 2, "0")
    op = F.when(k % 3 == 0, "<").when(k % 3 == 1, ">=").otherwise("=")
    quote = F.concat(F.lit("HR 1·"), digits, F.lit("; 95% CI, 0.50 to 2.00; P "), op, F.lit(" 0.05"))
    q = F.struct(
        F.lit("HR").alias("name"), (1 + F.col("p_size") / 100.0).alias("value"), F.lit("").alias("unit"), F.lit(0.5).alias("ci_low"), F.lit(2.0).alias("ci_high"), F.lit(0.05).alias("p_value"), quote.alias("source_quote"), F.lit("").alias("location_hint")
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("HR 1·"), digits).alias("quote"), Q.format_quantity(q).alias("shown"))


@query("""SELECT c_custkey, c_custkey % 4 IN (0, 1) OR c_custkey % 9 = 0 AS retracted FROM customer""")
def q65_retracted(spark, sf_dir):
    k = F.col("c_custkey")
    title = F.when(k % 4 == 0, "[Retracted] : on it").when(k % 4 == 1, "On it [RETRACTED].").otherwise("Retracted nerves: on it, not [retracted] at all")
    types = F.when(k % 9 == 0, F.array(F.lit("Journal Article"), F.lit(" retracted Publication"))).otherwise(F.array(F.lit("Retraction of Publication")))
    citation = F.struct(title.alias("title"), types.alias("pubtypes"), F.lit(None).cast("boolean").alias("retracted"))
    return table(spark, sf_dir, "customer").select("c_custkey", retractions.citation_retracted(citation).alias("retracted"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS pmid, CASE WHEN s_suppkey % 5 <> 0 THEN s_name || ' et al.' END AS author, CASE WHEN s_suppkey % 5 <> 0 THEN '2024' END AS year, CASE WHEN s_suppkey % 5 <> 0 THEN '10.1/' || s_suppkey END AS doi, s_suppkey % 5 <> 0 AS verified FROM supplier""")
def q66_citations(spark, sf_dir):
    k = F.col("s_suppkey")
    names = F.array(F.struct(F.col("s_name").alias("name")), F.struct(F.lit("B").alias("name")))
    record = F.struct(F.when(k % 5 != 0, "On it").alias("title"), F.lit("2024 Jan 3").alias("pubdate"), F.lit("J").alias("source"), F.concat(F.lit("doi: 10.1/"), k).alias("elocationid"), names.alias("authors"))
    parsed = records.citations(table(spark, sf_dir, "supplier").select(k.cast("string").alias("pmid"), F.to_json(record).alias("json")))
    return parsed.select("pmid", "author", "year", "doi", "verified")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS measure, p_retailprice AS value, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS ci_low FROM part WHERE p_partkey % 4 <> 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, 2.5, NULL FROM part""")
def q67_registry_rows(spark, sf_dir):
    k = F.col("p_partkey")
    first = F.struct(
        F.when(k % 4 != 0, F.concat(F.lit(" "), F.col("p_retailprice").cast("string"), F.lit(" (x)"))).otherwise("<0.001").alias("paramValue"),
        F.when(k % 3 != 0, F.col("p_size").cast("string")).otherwise("").alias("ciLowerLimit"),
    )
    second = F.struct(F.lit("2.5").alias("paramValue"), F.lit(None).cast("string").alias("ciLowerLimit"))
    json = F.to_json(F.array(F.struct(F.col("p_name").alias("title"), F.array(first, second).alias("analyses"))))
    rows = records.registry_rows(table(spark, sf_dir, "part").select(k.cast("string").alias("id"), json.alias("json")))
    return rows.select("id", "measure", "value", "ci_low")
