"""Retraction: by publication type, by title, and kept in step with current citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

RETRACTED_TYPE = "retracted publication"
BATCH = 100


def as_list(value: Column) -> Column:
    """A scalar as a list of one; null as an empty list."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value))


def retracted_type(types: Column) -> Column:
    """Exactly the retracted paper's type; the notice of a retraction is another."""
    return F.coalesce(F.exists(types, lambda t: X.key_of(t) == RETRACTED_TYPE), F.lit(False))


def retracted_title(title: Column) -> Column:
    t = X.trim(F.coalesce(title, F.lit("")))
    return t.rlike("(?i)^\\[?retracted\\]?\\s*[:.\\-]") | t.rlike("(?i)\\[retracted\\]\\s*\\.?$")


def citation_retracted(citation: Column) -> Column:
    """Of a citation struct (title, pubtypes, retracted)."""
    return F.coalesce(citation["retracted"], F.lit(False)) | retracted_type(citation["pubtypes"]) | retracted_title(citation["title"])


def text_citation_retracted(citation: Column) -> Column:
    """Of a citation that is only a string."""
    return F.coalesce(citation.rlike("(?i)(?<![A-Za-z0-9_])retracted publication(?![A-Za-z0-9_])"), F.lit(False)) | retracted_title(citation)


def paper_retracted(paper_flag: Column, citation: Column) -> Column:
    return F.coalesce(paper_flag, F.lit(False)) | F.coalesce(citation_retracted(citation), F.lit(False))


def retraction_patches(papers: DataFrame, current: DataFrame, now: str) -> DataFrame:
    """id, retracted, retraction, citation for saved papers (id, pmid, retracted, citation) whose
    current citation (pmid, title, pubtypes, retracted) says retracted and that aren't marked yet.
    Fields that only the saved citation has are kept."""
    fresh = current.select(F.col("pmid"), F.struct(*current.columns).alias("_now")).where(citation_retracted(F.col("_now")))
    todo = papers.where(~paper_retracted(F.col("retracted"), F.col("citation")))
    why = F.struct(
        F.lit(True).alias("retracted"), F.lit("PubMed").alias("source"), F.lit(now).alias("checkedAt"),
        F.lit("PubMed classifies this article as a Retracted Publication.").alias("reason"),
    )
    newer = lambda f: F.coalesce(F.col(f"_now.{f}"), F.col(f"citation.{f}"))
    citation = F.col("citation").withField("title", newer("title")).withField("pubtypes", newer("pubtypes")).withField("retracted", F.lit(True))
    return todo.join(fresh, "pmid").select("id", F.lit(True).alias("retracted"), why.alias("retraction"), citation.alias("citation"))


def remove_paper(concepts: DataFrame, pmid: str) -> DataFrame:
    """Only the concepts that cite the paper, without it."""
    return concepts.where(F.array_contains("sourcePmids", pmid)).withColumn("sourcePmids", F.array_remove("sourcePmids", pmid))
