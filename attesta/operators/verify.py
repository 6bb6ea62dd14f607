"""The verification gate: is a quantity printed where its quote says?

A quote is located in the source, the numbers *inside that span of the source* are read, and every
number of the quantity must be among them. Numbers of the quote itself never count, so a quote cut
out of a longer number verifies nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quantities as Q
from ..functions import text as X

FLAGGED, REGISTRY, ABSTRACT, FULL_TEXT = "flagged", "verified-registry", "abstract-only", "verified-full-text"


def _match(quote: Column, prose: Column, tables: Column, hint: Column) -> Column:
    """struct<corpus, index, length, fuzzy> in the corpus that the hint prefers, else the other."""
    prefers_table = F.lower(F.coalesce(hint, F.lit(""))).rlike("table|tbl")

    def named(corpus: str, text: Column) -> Column:
        return X.let(
            X.locate(quote, text),
            lambda m: F.when(m["found"], F.struct(F.lit(corpus).alias("corpus"), m["index"].alias("index"), m["length"].alias("length"), m["fuzzy"].alias("fuzzy"))),
        )

    in_prose, in_tables = named("prose", prose), named("tables", tables)
    return F.when(prefers_table, F.coalesce(in_tables, in_prose)).otherwise(F.coalesce(in_prose, in_tables))


def registry_match(q: Column, rows: Column) -> Column:
    """The first registry row with the quantity's value; where it posts an interval, the quantity
    needs both bounds, and each posted one must agree."""

    def fits(r: Column) -> Column:
        posted = r["ci_low"].isNotNull() | r["ci_high"].isNotNull()
        both = q["ci_low"].isNotNull() & q["ci_high"].isNotNull()
        agrees = lambda f: r[f].isNull() | X.numbers_equal(q[f], r[f])
        return F.coalesce(X.numbers_equal(q["value"], r["value"]), F.lit(False)) & (~posted | (both & F.coalesce(agrees("ci_low") & agrees("ci_high"), F.lit(False))))

    return F.get(F.filter(F.coalesce(rows, F.array().cast("array<struct<measure:string,value:double,ci_low:double,ci_high:double>>")), fits), F.lit(0))


def verify(claims: DataFrame) -> DataFrame:
    """Adds ``verdict`` to claims (quantity, text, tables, source_tier, registry; see schemas.CLAIM).

    verdict: tier, flagged, found, consistent, matched, quoteNums, badNums, reason, warnings. A null
    text or table is empty; a quantity without numbers is consistent once its quote is found. Row by
    row and without a shuffle; only rows beyond ASCII pass through Python, for NFKC.
    """
    df = claims.withColumn("_quote", F.col("quantity.source_quote"))
    df = X.normalize_frame(df, _q="_quote", _prose="text", _tables="tables")
    q = F.col("quantity")
    df = df.withColumn("_m", _match(F.col("_q"), F.col("_prose"), F.col("_tables"), q["location_hint"]))
    corpus = F.when(F.col("_m.corpus") == "tables", F.col("_tables")).otherwise(F.col("_prose"))
    none = F.array().cast("array<double>")
    in_span = X.numbers_in_span(corpus, F.col("_m.index"), F.col("_m.index") + F.col("_m.length"))
    df = df.withColumn("_nums", F.when(F.col("_m").isNotNull(), in_span).otherwise(none))
    claimed = F.array_compact(F.array(*(q[f] for f in ("value", "ci_low", "ci_high", "p_value"))))
    df = df.withColumn("_bad", F.filter(claimed, lambda n: ~X.any_equal(F.col("_nums"), n)))
    found = F.col("_m").isNotNull()
    consistent = found & (F.size("_bad") == 0)
    df = df.withColumn("_reg", F.when(consistent, registry_match(q, F.col("registry"))))
    reg = F.col("_reg")
    abstract = F.coalesce(F.col("source_tier"), F.lit("full_text")) == "abstract_only"
    tier = F.when(~consistent, FLAGGED).when(reg.isNotNull(), REGISTRY).when(abstract, ABSTRACT).otherwise(FULL_TEXT)
    label = F.when(F.coalesce(reg["measure"], F.lit("")) != "", F.concat(F.lit(' ("'), reg["measure"], F.lit('")'))).otherwise("")
    posted = reg["ci_low"].isNotNull() | reg["ci_high"].isNotNull()
    listed = F.array_join(F.transform("_bad", Q.shown), ", ")
    reason = (
        F.when(~found, F.lit("Quote not found in source text."))
        .when(~consistent, F.concat(F.lit("Quote located, but "), listed, F.lit(" is not present in it — the value does not match the source.")))
        .when(reg.isNotNull() & posted, F.concat(F.lit("Value and 95% CI match the ClinicalTrials.gov posted outcome"), label, F.lit(".")))
        .when(reg.isNotNull(), F.concat(F.lit("Value matches the ClinicalTrials.gov posted outcome"), label, F.lit(".")))
        .when(abstract, F.lit("Verified against the abstract; full text not in the OA subset."))
        .otherwise(F.lit("Verified against the full source text."))
    )
    verdict = F.struct(
        tier.alias("tier"), (tier == FLAGGED).alias("flagged"), found.alias("found"), consistent.alias("consistent"), F.col("_m").alias("matched"),
        F.col("_nums").alias("quoteNums"), F.col("_bad").alias("badNums"), reason.alias("reason"), Q.plausibility_warnings(q, consistent).alias("warnings"),
    )
    return df.select(*claims.columns, verdict.alias("verdict"))


def corrupted_value(q: Column) -> Column:
    """A value that the quote does not print: the first of value + 0.1, 0.2, … 5.0 that equals no
    number of the quote or the quantity. For quotes in NFKC."""
    taken = F.array_compact(F.concat(F.array(q["ci_low"], q["ci_high"], q["p_value"]), X.numbers(X.normalize(q["source_quote"]))))

    def first_free(t: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda k: F.round(q["value"] + k * F.lit(0.1), 6))
        return F.coalesce(F.get(F.filter(tries, lambda x: ~X.any_equal(t, x)), F.lit(0)), F.round(q["value"] * 1.7 + 0.13, 6))

    return X.let(taken, first_free)


def corrupt_and_reverify(verified: DataFrame) -> DataFrame:
    """Claims that passed, with a value that isn't printed, verified again: ``original`` and the new
    verdict. Every one must be flagged."""
    clean = verified.where(~F.col("verdict.flagged") & F.col("quantity.value").isNotNull()).drop("verdict")
    clean = clean.withColumn("original", F.col("quantity.value"))
    return verify(clean.withColumn("quantity", F.col("quantity").withField("value", corrupted_value(F.col("quantity")))))
