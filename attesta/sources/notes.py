"""Writing notes: a text file per row, and reading one back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render
from ..functions.text import in_form
from ..operators import drain as D
from ..operators import library as L
from ..operators.domains import with_labels


def paper_notes(papers: DataFrame, domains: DataFrame) -> DataFrame:
    """path, contents of each paper's note."""
    slug = render.source_slug(F.col("savedAt"), in_form(F.col("title"), "NFKD"), F.col("pmid"))
    return with_labels(papers, domains).select(F.concat(F.lit("sources/"), slug, F.lit(".md")).alias("path"), render.source_note().alias("contents"))


def concept_notes(concepts: DataFrame, papers: DataFrame, domains: DataFrame) -> DataFrame:
    """path, contents of each concept's note with its papers, by title."""
    of = L.members(papers, concepts).join(papers.select(F.col("id").alias("paper_id"), "title", "citation", "pmid"), "paper_id")
    lists = of.groupBy(F.col("concept_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("title", "pmid", "citation"))).alias("_papers"))
    none = F.array().cast(lists.schema["_papers"].dataType)
    rows = with_labels(concepts, domains).join(lists, "id", "left").withColumn("_papers", F.coalesce("_papers", none))
    return rows.select(F.concat(F.lit("concepts/"), render.concept_slug(F.col("label")), F.lit(".md")).alias("path"), render.concept_note(F.col("_papers")).alias("contents"))


def memo_notes(memos: DataFrame) -> DataFrame:
    return memos.select(render.memo_file(F.col("createdAt")).alias("path"), render.memo_note().alias("contents"))


def all_notes(papers: DataFrame, concepts: DataFrame, memos: DataFrame, domains: DataFrame, owner: str, app: str = "this app") -> DataFrame:
    """Every note of a library and its cover page."""
    counts = papers.agg(F.count("*").alias("s")).withColumn("_k", F.lit(1)).join(concepts.agg(F.count("*").alias("c")).withColumn("_k", F.lit(1)), "_k")
    cover = counts.select(F.lit("README.md").alias("path"), render.readme(F.lit(owner), F.col("s"), F.col("c"), app).alias("contents"))
    return paper_notes(papers, domains).unionByName(concept_notes(concepts, papers, domains)).unionByName(memo_notes(memos)).unionByName(cover)


def stale_notes(papers: DataFrame, concepts: DataFrame, memos: DataFrame, domains: DataFrame) -> DataFrame:
    """Only the notes of records that changed since they were written, and of their concepts."""
    todo = papers.where(D.needs_write())
    touched = concepts.join(D.stale_concepts(todo).select(F.col("conceptId").alias("id")), "id", "left_semi")
    return paper_notes(todo, domains).unionByName(concept_notes(touched, papers, domains)).unionByName(memo_notes(memos.where(D.needs_write())))


def write_notes(notes: DataFrame, folder: str) -> None:
    """Write notes (path, contents) through the file system that the folder is on, each one whole: first
    beside its place, then renamed into it, so a retried task or a reader never sees half a note."""
    spark = notes.sparkSession
    staged = f"{folder.rstrip('/')}/_notes"
    notes.write.mode("overwrite").parquet(staged)
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for row in spark.read.parquet(staged).toLocalIterator():
        target = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{row['path']}")
        fs = target.getFileSystem(conf)
        fs.mkdirs(target.getParent())
        half = target.suffix(".part")
        out = fs.create(half, True)
        out.write(bytearray(row["contents"].encode()))
        out.close()
        fs.delete(target, False)
        fs.rename(half, target)
    path = jvm.org.apache.hadoop.fs.Path(staged)
    path.getFileSystem(conf).delete(path, True)


def read_note(spark: SparkSession, path: str) -> str | None:
    """A note's text; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""
