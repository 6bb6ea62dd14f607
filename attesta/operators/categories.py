"""Shelves: a plan that files every concept under at most nine categories and Other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

CATEGORY_CAP, MOST_HUBS, REORGANIZE_AT = 9, 10, 8
OTHER = "Other"


def shelf_summary(label: Column) -> Column:
    other = F.lit("Papers that don’t yet fit one of this library’s named categories.")
    return F.when(X.key_of(label) == OTHER.lower(), other).otherwise(F.concat(F.lit("A category shelf gathering this library’s work on "), label, F.lit(".")))


def filed_concepts(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """id: sources of taxonomy edges to a real hub."""
    hubs = concepts.where("isHub").select(F.col("id").alias("target"))
    return edges.where("origin = 'taxonomy'").join(hubs, "target", "left_semi").select(F.col("source").alias("id")).distinct()


def gates(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: hubs, unfiled, categorized (few hubs and all filed), reorganize (too many of either)."""
    filed = filed_concepts(concepts, edges).withColumn("filed", F.lit(True))
    rows = concepts.join(filed, "id", "left")
    hub = F.coalesce("isHub", F.lit(False))
    out = rows.agg(F.count_if(hub).alias("hubs"), F.count_if(~hub & F.col("filed").isNull()).alias("unfiled"))
    return out.withColumn("categorized", (F.col("hubs") <= MOST_HUBS) & (F.col("unfiled") == 0)).withColumn("reorganize", (F.col("hubs") > MOST_HUBS) | (F.col("unfiled") >= REORGANIZE_AT))


def cap_categories(categories: DataFrame, cap: int = CATEGORY_CAP) -> DataFrame:
    """The ``cap`` largest (size, then idx), in the order of idx."""
    return categories.orderBy(F.desc("size"), "idx").limit(cap).orderBy("idx")


def first_assignment(members: DataFrame) -> DataFrame:
    """Members (shelf, shelf_pos, member, member_pos), each on the first shelf that names it; a null is no
    shelf, and a member with nothing else stays with null."""
    at = F.when(F.col("shelf").isNotNull(), F.struct("shelf_pos", "member_pos"))
    return members.groupBy("member").agg(F.min_by("shelf", at).alias("shelf"))


@dataclass
class Plan:
    """shelves (id, label, pos, summary, existing), assigned (member, shelf), add (member, shelf), remove
    (id: of edges), demote (id: of hubs); filed: how many members."""

    shelves: DataFrame
    assigned: DataFrame
    add: DataFrame
    remove: DataFrame
    demote: DataFrame

    def filed(self) -> int:
        return self.assigned.count()


def plan_categorization(proposal: DataFrame, concepts: DataFrame, edges: DataFrame, cap: int = CATEGORY_CAP) -> Plan:
    """From a proposal (cat_pos, label, member, member_pos), concepts (schemas.NODE with pos) and edges
    (with pos): unknown members dropped, same labels merged, blank and Other pooled, the largest kept,
    hubs of the same label reused, first shelf wins, existing filing kept, the rest to Other."""
    ids = concepts.select(F.col("id").alias("member"))
    hubs = concepts.where("isHub").select("id", "label", "pos")
    named = proposal.withColumn("key", X.key_of(F.col("label"))).where((F.col("key") != "") & (F.col("key") != OTHER.lower()))
    known = named.join(ids, "member", "left_semi")
    heads = named.groupBy("key").agg(F.min("cat_pos").alias("idx"), F.min_by(X.trim(F.col("label")), "cat_pos").alias("label"))
    sizes = known.groupBy("key").agg(F.countDistinct("member").alias("size"))
    kept = cap_categories(heads.join(sizes, "key", "left").fillna(0, ["size"]).where("size > 0"), cap)
    hub_of = hubs.select(X.key_of(F.col("label")).alias("key"), F.struct("pos", "id", "label").alias("h")).groupBy("key").agg(F.min("h").alias("h"))
    resolved = kept.join(hub_of, "key", "left").select(
        "key", "idx", F.coalesce("h.id", X.concept_id(F.col("label"))).alias("id"), F.coalesce("h.label", "label").alias("label"), F.col("h.id").isNotNull().alias("existing")
    )
    shelves = resolved.groupBy("id").agg(F.min("idx").alias("pos"), F.min_by("label", "idx").alias("label"), F.bool_or("existing").alias("existing"))

    other_slug = "concept:other"
    other_hub = hubs.where(X.key_of(F.col("label")) == OTHER.lower()).orderBy("pos").limit(1).select(F.col("id").alias("other"))
    # at most one row: the hub, else the slug unless a named shelf has taken it
    slug = shelves.agg(F.count_if(F.col("id") == other_slug).alias("n")).where("n = 0").select(F.lit(other_slug).alias("other"))
    other = other_hub.withColumn("rank", F.lit(0)).unionByName(slug.withColumn("rank", F.lit(1))).orderBy("rank").limit(1).select("other", (F.col("rank") == 0).alias("existing"))

    shelf_ids = shelves.select("id").unionByName(other.select(F.col("other").alias("id"))).distinct()
    by_proposal = known.join(resolved.select("key", "id", "idx"), "key").join(shelf_ids.select(F.col("id").alias("member")), "member", "left_anti")
    assigned = first_assignment(by_proposal.select(F.col("id").alias("shelf"), F.col("idx").alias("shelf_pos"), "member", "member_pos"))
    rest = concepts.select(F.col("id").alias("member")).join(shelf_ids.select(F.col("id").alias("member")), "member", "left_anti").join(assigned.select("member"), "member", "left_anti")
    taxonomy = edges.where("origin = 'taxonomy'")
    current = taxonomy.join(shelf_ids.select(F.col("id").alias("target")), "target", "left_semi").groupBy(F.col("source").alias("member")).agg(F.min_by("target", "pos").alias("shelf"))
    # one row of ``other`` against all: its id travels as a key
    fallback = rest.join(current, "member", "left").withColumn("_k", F.lit(1)).join(F.broadcast(other.withColumn("_k", F.lit(1))), "_k", "left")
    assigned = assigned.select("member", "shelf").unionByName(fallback.select("member", F.coalesce("shelf", "other").alias("shelf")).where("shelf IS NOT NULL"))

    used = assigned.select(F.col("shelf").alias("id")).distinct()
    needed = other.select(F.col("other").alias("id"), "existing").join(used.withColumn("used", F.lit(True)), "id", "left").where("existing OR used")
    last = needed.select("id", F.lit(1 << 30).alias("pos"), F.lit(OTHER).alias("label"), "existing")
    all_shelves = shelves.select("id", "pos", "label", "existing").unionByName(last).withColumn("summary", shelf_summary(F.col("label")))

    wanted = assigned.withColumn("id", X.edge_id(F.col("member"), F.col("shelf")))
    add = wanted.join(edges.select("id"), "id", "left_anti").select("member", "shelf")
    moved = taxonomy.join(assigned.select(F.col("member").alias("source"), "shelf"), "source").where("target <> shelf").select("id")
    from_shelf = taxonomy.join(all_shelves.select(F.col("id").alias("source")), "source", "left_semi").select("id")
    demote = hubs.select("id").join(all_shelves.select("id"), "id", "left_anti")
    return Plan(all_shelves, assigned, add, moved.unionByName(from_shelf).distinct(), demote)


def apply_plan(plan: Plan, concepts: DataFrame, edges: DataFrame, now: str) -> list[tuple[str, DataFrame]]:
    """What to write, in this order: each prefix leaves a working graph. Nodes to put, edges to add,
    edges to remove (ids), hubs to demote (nodes to put)."""
    old = concepts.select("id", F.struct(*concepts.columns).alias("o"))
    nodes = plan.shelves.join(old, "id", "left").select(
        "id", F.lit("concept").alias("kind"), "label", F.coalesce(X.nz(F.col("o.summary")), "summary").alias("summary"), F.lit(True).alias("isHub"),
        F.coalesce("o.sourcePmids", F.array().cast("array<string>")).alias("sourcePmids"), F.lit(now).alias("updatedAt"),
    )
    labelled = plan.add.join(plan.shelves.select(F.col("id").alias("shelf"), "label"), "shelf")
    new_edges = labelled.select(
        X.edge_id(F.col("member"), F.col("shelf")).alias("id"), F.col("member").alias("source"), F.col("shelf").alias("target"), F.lit("confirmed").alias("status"),
        F.lit("taxonomy").alias("origin"), F.concat(F.lit("part of “"), "label", F.lit("”")).alias("rationale"), F.lit(now).alias("ts"), F.lit(now).alias("confirmedAt"),
    )
    demoted = concepts.join(plan.demote, "id", "left_semi").withColumn("isHub", F.lit(False)).withColumn("updatedAt", F.lit(now))
    return [("put nodes", nodes), ("add edges", new_edges), ("remove edges", plan.remove), ("put nodes", demoted)]


def resolve_category(labels: DataFrame, hubs: DataFrame) -> DataFrame:
    """labels (label) with ``hub``: the first hub (id, label, pos) of the same label, case and spaces aside."""
    first = hubs.select(X.key_of(F.col("label")).alias("_key"), F.struct("pos", "id").alias("h")).groupBy("_key").agg(F.min("h")["id"].alias("hub"))
    return labels.withColumn("_key", X.key_of(F.col("label"))).join(first, "_key", "left").drop("_key")


def file_papers(filings: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Filings (pmid, concept, hub, domain, tags) with ``concept_id`` and ``hub_id``: straight onto a shelf
    if that is the concept, else under the shelf it is on already, else the named one, else Other."""
    hubs = concepts.where("isHub").select("id", "label", "pos")
    named = resolve_category(filings.select("*", F.col("hub").alias("label")).drop("hub"), hubs)
    rows = named.drop("label").withColumn("concept_id", X.concept_id(F.col("concept")))
    shelves = hubs.select("id")
    current = edges.where("origin = 'taxonomy'").join(shelves.select(F.col("id").alias("target")), "target", "left_semi").groupBy(F.col("source").alias("concept_id")).agg(F.min_by("target", "pos").alias("_now"))
    direct = shelves.select(F.col("id").alias("concept_id"), F.lit(True).alias("_shelf"))
    rows = rows.join(current, "concept_id", "left").join(direct, "concept_id", "left")
    hub = F.when(F.col("_shelf"), F.lit(None)).otherwise(F.coalesce("_now", "hub", F.lit("concept:other")))
    return rows.withColumn("hub_id", hub).drop("_now", "_shelf", "hub")


def sanitize_filing(concept: Column, hub: Column, banned: Column) -> tuple[Column, Column]:
    """Concept and hub that aren't the names of projects (``banned``: trimmed, lower-case)."""
    bad = lambda c: F.coalesce(F.array_contains(banned, X.key_of(c)), F.lit(False))
    h = F.when(bad(hub), concept).otherwise(hub)
    c = F.when(bad(concept), F.when(bad(h), F.lit("Uncategorized")).otherwise(h)).otherwise(concept)
    return c, F.when(bad(h), c).otherwise(h)
