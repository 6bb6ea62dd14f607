"""Papers put on the shelves of a library and taken off again: saving, deleting, filing anew.

Every function takes whole tables and returns whole tables, for any number of papers at a time. What a
job returns is in the order in which it is to be written: a job that breaks off leaves a library that
works, and can be run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import materialize
from . import categories, graph, library, models, retractions


def put(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The rows of ``new`` in place of those of the same key; columns that it lacks are null."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True).select(*rows.columns)


def patch(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the columns of ``changes`` (one row a key) where it has the key; others as they were."""
    fields = [c for c in changes.columns if c != key]
    found = changes.select(key, F.struct(*fields).alias("_new"))
    joined = rows.join(found, key, "left")
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) if c in fields else F.col(c)
    return joined.select(*(value(c).alias(c) for c in rows.columns))


def toggle_saved(papers: DataFrame, records: DataFrame) -> DataFrame:
    """Papers without those of the records that are there, heart and all, and with the others, unless
    they are retracted."""
    gone = papers.join(records.select("id"), "id", "left_anti")
    fresh = records.join(papers.select("id"), "id", "left_anti").where(~_retracted(records))
    return gone.unionByName(fresh, allowMissingColumns=True).select(*papers.columns)


def favorite(papers: DataFrame, records: DataFrame) -> DataFrame:
    """Papers with the records' hearts flipped; a record that isn't saved is saved with its heart on,
    unless it is retracted."""
    flipped = papers.join(records.select("id"), "id", "left_semi").select("id", (~F.coalesce("favorite", F.lit(False))).alias("favorite"))
    fresh = records.join(papers.select("id"), "id", "left_anti").where(~_retracted(records)).withColumn("favorite", F.lit(True))
    return patch(papers, flipped).unionByName(fresh, allowMissingColumns=True).select(*papers.columns)


def _retracted(rows: DataFrame) -> Column:
    flag = F.coalesce("retracted", F.lit(False)) if "retracted" in rows.columns else F.lit(False)
    return retractions.paper_retracted(flag, F.col("citation")) if "citation" in rows.columns else flag


def delete_concepts(papers: DataFrame, nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers, nodes and edges without the concepts ``gone`` (id): their edges go, their papers stay
    and are filed nowhere. Hubs can't be deleted."""
    concepts = nodes.join(gone.select("id"), "id", "left_semi").where("kind = 'concept'").where(~F.coalesce("isHub", F.lit(False)))
    orphans = library.members(papers, concepts).select(F.col("paper_id").alias("id")).distinct()
    left, links = graph.remove_nodes(nodes, edges, concepts.select("id"))
    return patch(papers, orphans.withColumn("conceptId", F.lit(None).cast("string"))), left, links


def delete_papers(papers: DataFrame, nodes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers without ``gone`` (id), and all nodes, none of which cites one of these."""
    pmids = papers.join(gone.select("id"), "id", "left_semi").where("pmid <> ''").select("pmid")
    cites = nodes.select("id", F.posexplode("sourcePmids").alias("at", "pmid")).withColumn("pmid", F.col("pmid").cast("string"))
    touched = cites.join(pmids, "pmid", "left_semi").select("id").distinct()
    kept = cites.join(touched, "id", "left_semi").join(pmids, "pmid", "left_anti").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "pmid")))["pmid"].alias("sourcePmids"))
    none = F.array().cast("array<string>")
    changes = touched.join(kept, "id", "left").select("id", F.coalesce("sourcePmids", none).alias("sourcePmids"))
    return papers.join(gone.select("id"), "id", "left_anti"), patch(nodes, changes)


def fill_links(papers: DataFrame, resolved: DataFrame) -> DataFrame:
    """Papers with open-access links (doi, pdf, landing): only those with neither link and a DOI get one,
    a file's if there is one, else a page's. A DOI that wasn't resolved changes nothing."""
    links = resolved.where("coalesce(nullif(pdf, ''), landing, '') <> ''").groupBy("doi").agg(F.max(F.struct("pdf", "landing")).alias("_l"))
    bare = (F.coalesce("pdfUrl", F.lit("")) == "") & (F.coalesce("oaUrl", F.lit("")) == "")
    todo = papers.where(bare).select("id", F.col("citation.doi").alias("doi")).where("doi <> ''")
    found = todo.join(links, "doi").select("id", X.nz(F.col("_l.pdf")).alias("pdfUrl"), F.when(X.nz(F.col("_l.pdf")).isNull(), F.col("_l.landing")).alias("oaUrl"))
    return patch(papers, found)


def summarize(papers: DataFrame, nodes: DataFrame, touched: DataFrame, model: models.Model, now: str) -> DataFrame:
    """Nodes with the summaries of the concepts ``touched`` (id) made anew of their papers (title,
    finding; in the order of their ids). Without papers or a sensible answer a summary stays. The
    prompt of a concept has all its papers, as a shelf of one reader's library."""
    concepts = nodes.join(touched.select("id").distinct(), "id", "left_semi")
    of = library.members(papers, concepts).join(papers.select(F.col("id").alias("paper_id"), "title", "finding"), "paper_id")
    text = F.concat(F.coalesce(X.nz(F.col("title")), F.lit("(untitled)")), F.lit("\n   Finding: "), F.coalesce(X.nz(F.col("finding")), F.lit("(no verified finding)")))
    listed = of.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("paper_id", text.alias("text")))).alias("p")).join(concepts.select(F.col("id").alias("concept_id"), "label"), "concept_id")
    lines = F.array_join(F.transform("p", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["text"])), "\n")
    prompt = F.concat(F.lit("CONCEPT: "), F.col("label"), F.lit("\n\nSOURCE PAPERS ("), F.size("p").cast("string"), F.lit("):\n"), lines)
    answers = models.ask(listed.withColumnRenamed("concept_id", "id"), prompt, "summarize", model)
    made = answers.select("id", X.trim(F.coalesce("answer.summary", F.lit(""))).alias("summary")).where("summary <> ''")
    return patch(nodes, made.withColumn("updatedAt", F.lit(now)))


def reset_filing(papers: DataFrame, nodes: DataFrame, edges: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nothing filed any more: satellites and their edges go, hubs stay without sources, papers have
    neither concept nor domain."""
    hub = F.coalesce("isHub", F.lit(False))
    satellites = nodes.where("kind = 'concept'").where(~hub).select("id")
    left, links = graph.remove_nodes(nodes, edges, satellites)
    emptied = hub & (F.size(F.coalesce("sourcePmids", F.array().cast("array<string>"))) > 0)
    left = left.withColumn("updatedAt", F.when(emptied, F.lit(now)).otherwise(F.col("updatedAt")))
    left = left.withColumn("sourcePmids", F.when(hub, F.array().cast("array<string>")).otherwise(F.col("sourcePmids")))
    bare = papers.withColumns({"conceptId": F.lit(None).cast("string"), "domain": F.lit(None).cast("string")})
    return bare, left, links


def file_under(papers: DataFrame, nodes: DataFrame, edges: DataFrame, filings: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers, nodes and edges after filing: filings as ``categories.file_papers`` gives them. Concepts are
    merged with those there, each named by its first paper (pmid), and linked to their hub if it is one."""
    rows = materialize(filings, "filings")
    named = rows.groupBy("concept_id").agg(
        F.min_by("concept", "pmid").alias("name"), F.min_by("domain", "pmid").alias("domain"), F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct("pmid", "tags")))["tags"])).alias("tags"),
        F.array_sort(F.collect_set("pmid")).alias("sourcePmids"), F.min_by("hub_id", F.when(F.col("hub_id").isNotNull(), F.col("pmid"))).alias("hub"),
    )
    new = named.select("name", X.nz(F.col("domain")).alias("domain"), "tags", F.lit("").alias("summary"), "sourcePmids", F.lit(False).alias("isHub"))
    if not nodes.where("isHub").isEmpty():  # where there are shelves, there is one for what fits none
        none = F.array().cast("array<string>")
        other = rows.where(F.col("hub_id") == "concept:other").select(F.lit("Other").alias("name"), F.lit(None).cast("string").alias("domain"), none.alias("tags"), F.lit("").alias("summary"), none.alias("sourcePmids"), F.lit(True).alias("isHub")).distinct()
        new = new.unionByName(other)
    merged = put(nodes, graph.upsert_concepts(nodes, new, now))
    hubs = merged.where("isHub").select(F.col("id").alias("hub"), "label")
    links = named.where("hub IS NOT NULL").join(hubs, "hub").select(F.col("concept_id").alias("satellite"), "hub", "label")
    shelved = put(edges, graph.link_to_hub(edges, links, now))
    filed = rows.groupBy("pmid").agg(F.min(F.struct("concept_id", "domain", "tags")).alias("f"))
    changes = papers.select("id", "pmid").join(filed, "pmid").select("id", F.col("f.concept_id").alias("conceptId"), X.nz(F.col("f.domain")).alias("domain"), F.col("f.tags").alias("tags"))
    return patch(papers, changes), merged, shelved


def file_anew(
    papers: DataFrame, nodes: DataFrame, edges: DataFrame, projects: Column, now: str, analyze: models.Model = models.analyze_offline, summarizer: models.Model | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole library filed anew on the hubs that it has, and the summaries of what was touched."""
    bare, left, links = (materialize(t, f"reset-{i}") for i, t in enumerate(reset_filing(papers, nodes, edges, now)))
    answers = models.ask(bare, F.concat_ws("\n", "title", "finding"), "analyze", analyze)
    filed = models.filed(answers, projects).join(bare.select("id", "pmid"), "id").drop("id")
    hubs = left.where("isHub").withColumn("pos", F.xxhash64("id")) if "pos" not in left.columns else left.where("isHub")
    filings = categories.file_papers(filed, hubs, links.limit(0).withColumn("pos", F.lit(0)))
    done = file_under(bare, left, links, filings, now)
    if summarizer is None:
        return done
    after, concepts, shelved = (materialize(t, f"filed-{i}") for i, t in enumerate(done))
    touched = after.where("conceptId IS NOT NULL").select(F.col("conceptId").alias("id"))
    return after, summarize(after, concepts, touched, summarizer, now), shelved


def save(papers: DataFrame, nodes: DataFrame, edges: DataFrame, results: DataFrame, projects: Column, now: str, analyze: models.Model = models.analyze_offline, summarizer: models.Model | None = None,
         links: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run results (see ``library.paper_records``) saved and filed: the records are written first, then
    concepts, edges and summaries, then open-access links (doi, pdf, landing). Retracted ones are
    refused. A model that answers nothing sensible leaves the paper saved under Uncategorized."""
    records = materialize(library.paper_records(results, now), "records")
    # a record's citation may have fewer fields than the library's
    wanted = [f for f in papers.schema if f.name in records.columns]
    records = records.select(*(F.from_json(F.to_json(f.name), f.dataType.simpleString()).alias(f.name) if f.dataType.typeName() in ("struct", "array") else F.col(f.name) for f in wanted))
    saved = materialize(put(papers, records), "saved")
    fresh = saved.join(records.select("id"), "id", "left_semi")
    answers = models.ask(fresh, F.concat_ws("\n", "title", "finding"), "analyze", analyze)
    filed = models.filed(answers, projects).join(fresh.select("id", "pmid"), "id").drop("id")
    concepts = nodes.withColumn("pos", F.xxhash64("id")) if "pos" not in nodes.columns else nodes
    shelves = edges.withColumn("pos", F.xxhash64("id")) if "pos" not in edges.columns else edges
    after, merged, shelved = (materialize(t, f"save-{i}") for i, t in enumerate(file_under(saved, nodes, edges, categories.file_papers(filed, concepts, shelves), now)))
    if summarizer is not None:
        touched = after.join(records.select("id"), "id", "left_semi").where("conceptId IS NOT NULL").select(F.col("conceptId").alias("id"))
        merged = summarize(after, merged, touched, summarizer, now)
    return (after if links is None else fill_links(after, links)), merged, shelved
