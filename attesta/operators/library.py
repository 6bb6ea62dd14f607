"""Browsing the library: where papers live, groups, counts, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .domains import PALETTE


def hub_map(edges: DataFrame) -> DataFrame:
    """id, hub: the target of each concept's last taxonomy edge (pos)."""
    return edges.where("origin = 'taxonomy'").groupBy(F.col("source").alias("id")).agg(F.max_by("target", "pos").alias("hub"))


def paper_homes(papers: DataFrame, concepts: DataFrame) -> DataFrame:
    """Papers with ``home``: their concept if there is such a one, else the first concept (pos) that
    cites their pmid, else null."""
    ids = concepts.select(F.col("id").alias("conceptId"), F.col("id").alias("_own"))
    cites = concepts.select("pos", "id", F.explode("sourcePmids").alias("pmid")).groupBy("pmid").agg(F.min_by("id", "pos").alias("_cited"))
    return papers.join(ids, "conceptId", "left").join(cites, "pmid", "left").withColumn("home", F.coalesce("_own", "_cited")).drop("_own", "_cited").select(*papers.columns, "home")


def members(papers: DataFrame, concepts: DataFrame) -> DataFrame:
    """concept_id, paper_id: by the paper's concept or the concept's citations; two equi-joins."""
    by_concept = papers.join(concepts.select(F.col("id").alias("conceptId")), "conceptId", "left_semi").select(F.col("conceptId").alias("concept_id"), F.col("id").alias("paper_id"))
    cites = concepts.select(F.col("id").alias("concept_id"), F.explode("sourcePmids").alias("pmid"))
    by_citation = papers.select("pmid", F.col("id").alias("paper_id")).join(cites, "pmid").select("concept_id", "paper_id")
    return by_concept.unionByName(by_citation).distinct()


def _tag_match(q: Column) -> Column:
    return F.coalesce(F.exists("tags", lambda t: X.contains(t, q)), F.lit(False))


def concept_matches(q: Column) -> Column:
    return X.contains(F.col("label"), q) | X.contains(F.col("summary"), q) | _tag_match(q)


def paper_matches(q: Column) -> Column:
    return X.contains(F.col("title"), q) | X.contains(F.col("finding"), q) | X.contains(F.col("notes"), q) | _tag_match(q)


def browse(concepts: DataFrame, papers: DataFrame, edges: DataFrame, query: str = "", domain: str | None = None, topic: str | None = None) -> DataFrame:
    """place, concept_id, label, hub, n, papers (ids): the groups to show, largest first, then by label;
    the unfiled papers last, without a concept_id.

    A concept that matches the query shows all its papers, else those that match. The domain is that
    of the concept, for unfiled papers their own; with a topic nothing unfiled is shown."""
    q = F.lit((query or "").strip().lower())
    homes = paper_homes(papers, concepts).withColumn("_hit", paper_matches(q))
    c = concepts.join(hub_map(edges), "id", "left")
    if domain:
        c = c.where(F.col("domain") == domain)
    if topic:
        c = c.where((F.col("id") == topic) | (F.col("hub") == topic))
    c = c.select(F.col("id").alias("home"), "label", "hub", concept_matches(q).alias("_whole"))
    shown = homes.select("id", "home", "_hit").join(c, "home").where((q == "") | F.col("_whole") | F.col("_hit"))
    groups = shown.groupBy(F.col("home").alias("concept_id"), "label", "hub").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("papers"))
    place = F.row_number().over(W.orderBy(F.desc("n"), F.collate("label", "UNICODE"), "concept_id"))
    filed = groups.withColumn("place", place)
    loose = homes.where(F.col("home").isNull() & F.col("_hit") & F.lit(not topic))
    if domain:
        loose = loose.where(F.col("domain") == domain)
    none = F.lit(None).cast("string")
    unfiled = loose.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("papers")).where("n > 0")
    unfiled = unfiled.select(none.alias("concept_id"), none.alias("label"), none.alias("hub"), "n", "papers", F.lit(1 << 30).alias("place"))
    return filed.unionByName(unfiled).select("place", "concept_id", "label", "hub", "n", "papers")


def browse_counts(groups: DataFrame) -> DataFrame:
    """One row: groups and papers shown (with the unfiled ones)."""
    return groups.agg(F.count("concept_id").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("papers"))


def topic_counts(concepts: DataFrame, papers: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label, papers: papers under each hub, most first, then by label."""
    hub = F.when(F.col("isHub"), F.col("id")).otherwise(F.col("hub"))
    of = concepts.join(hub_map(edges), "id", "left").select(F.col("id").alias("home"), hub.alias("hub_id"))
    counted = paper_homes(papers, concepts).join(of, "home").groupBy("hub_id").agg(F.count("*").alias("papers"))
    hubs = concepts.where("isHub").select("id", "label")
    return hubs.join(counted.withColumnRenamed("hub_id", "id"), "id").orderBy(F.desc("papers"), F.collate("label", "UNICODE"))


def topic_index(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """id, topic, topic_label, color for every concept: hubs take colours in the order of their ids,
    the rest inherit; null without a hub."""
    hubs = concepts.where("isHub").select(F.col("id").alias("topic"), F.col("label").alias("topic_label"))
    palette = F.array(*map(F.lit, PALETTE))
    colored = hubs.withColumn("color", F.get(palette, (F.row_number().over(W.orderBy("topic")) - 1) % len(PALETTE)))
    own = F.when(F.col("isHub"), F.col("id")).otherwise(F.col("hub"))
    return concepts.join(hub_map(edges), "id", "left").select("id", own.alias("topic")).join(colored, "topic", "left").select("id", F.when(F.col("color").isNotNull(), F.col("topic")).alias("topic"), "topic_label", "color")


def rail_counts(papers: DataFrame) -> DataFrame:
    """One row: total, verified (a tier is given), flagged."""
    return papers.agg(F.count("*").alias("total"), F.count_if(F.coalesce("tier", F.lit("")) != "").alias("verified"), F.count_if(F.col("tier") == "flagged").alias("flagged"))


def focus_and_shelf(papers: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Papers with ``focus``: saved in the last days (inclusive); if none was, all of them."""
    recent = F.coalesce(F.try_to_timestamp("savedAt") >= now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    any_recent = papers.agg(F.bool_or(recent)).collect()[0][0]
    return papers.withColumn("focus", recent if any_recent else F.lit(True))


def by_title(papers: DataFrame) -> DataFrame:
    """Papers in the order of their titles, as a dictionary has them; a missing title is empty."""
    return papers.orderBy(F.collate(F.coalesce("title", F.lit("")), "UNICODE"), "id")


def without_tag(rows: DataFrame, id: str, tag: str) -> DataFrame:
    """Papers or concepts, one of them without a tag."""
    return rows.withColumn("tags", F.when(F.col("id") == id, F.array_remove("tags", tag)).otherwise(F.col("tags")))


def favorites(papers: DataFrame) -> DataFrame:
    return papers.where(F.coalesce("favorite", F.lit(False)))


def set_favorite(papers: DataFrame, id: str, favorite: bool | None = None) -> DataFrame:
    """With the flag of one paper set, or toggled; an unknown id changes nothing."""
    new = ~F.coalesce("favorite", F.lit(False)) if favorite is None else F.lit(favorite)
    return papers.withColumn("favorite", F.when(F.col("id") == id, new).otherwise(F.col("favorite")))


def paper_records(results: DataFrame, now: str) -> DataFrame:
    """Records to save from run results (paper, citation, rows, source_text, tables, take): without flagged
    quantities, with each one's tier; retracted papers are refused."""
    rows = F.filter("rows", lambda r: ~r["verdict"]["flagged"])
    quantities = F.transform(rows, lambda r: r["quantity"].withField("tier", r["verdict"]["tier"]))
    refused = F.coalesce("retracted", F.lit(False)) | F.coalesce("citation.retracted", F.lit(False))
    take = lambda f: F.coalesce(f"take.{f}", F.lit(""))
    return results.where(~refused).select(
        F.col("paper.id").alias("id"), F.col("paper.pmid").alias("pmid"), F.col("paper.pmcid").alias("pmcid"), F.coalesce(X.nz(F.col("citation.title")), "paper.title").alias("title"), "citation",
        F.col("take.tier").alias("tier"), take("finding").alias("finding"), take("relevance").alias("relevance"), F.col("take.check").alias("check"), quantities.alias("quantities"),
        F.coalesce("source_text", F.lit("")).alias("fullText"), F.coalesce("tables", F.lit("")).alias("tables"), F.array().cast("array<string>").alias("tags"), F.lit("").alias("notes"), F.lit(now).alias("savedAt"),
    )


def weekend_threads(threads: DataFrame, focus: DataFrame, library: DataFrame) -> DataFrame:
    """Threads (pos, anchor, pmids, narrative) with only known papers (pmid), and only those that have
    one from the focus set."""
    known = focus.select("pmid", F.lit(1).alias("f")).unionByName(library.select("pmid", F.lit(0).alias("f"))).groupBy("pmid").agg(F.max("f").alias("f"))
    rows = threads.select("pos", "anchor", "narrative", F.posexplode(F.array_distinct("pmids")).alias("at", "pmid")).join(known, "pmid")
    out = rows.groupBy("pos", "anchor", "narrative").agg(F.sum("f").alias("_f"), F.transform(F.array_sort(F.collect_list(F.struct("at", "pmid"))), lambda x: x["pmid"]).alias("pmids"))
    return out.where("_f > 0").select("pos", "anchor", "pmids", "narrative")


def anchor_kind(anchor: Column, projects: Column, stars: Column) -> Column:
    has = lambda items: F.exists(items, lambda x: X.key_of(x) == X.key_of(anchor))
    return F.when(has(projects), "project").when(has(stars), "northStar").otherwise("cross")
