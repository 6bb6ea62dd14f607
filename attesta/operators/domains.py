"""Domains: resolved by key, label or name; counted; sparse ones merged away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

# Colours in the order in which they are given out; domains of old libraries.
PALETTE = "#e0605a #5b93d6 #a06cd5 #45ac6d #29bccd #e6912e #d6789c #8fbde6 #b8c26a #7fbf9a #c98f5b #9a86e8".split()
LEGACY = [
    ("vascular", "Vascular Surgery & Limb Preservation", "#e0605a"),
    ("datascience", "Health Data Science & Biostatistics", "#5b93d6"),
    ("education", "Surgical Education", "#a06cd5"),
    ("methodology", "Research Methodology", "#45ac6d"),
    ("ai", "AI & Technology in Medicine", "#29bccd"),
    ("leadership", "Program Building & Leadership", "#e6912e"),
]
DEFAULT_COLOR = "#6fa8ff"
SPARSE, LEAST_FIELDS = 3, 4


def next_color(used: Column) -> Column:
    """The first colour not used yet; if all are, round again by how many there are."""
    palette = F.array(*map(F.lit, PALETTE))
    return F.coalesce(F.get(F.array_except(palette, used), F.lit(0)), F.get(palette, F.size(used) % len(PALETTE)))


def domain_counts(papers: DataFrame) -> DataFrame:
    return papers.where("domain IS NOT NULL AND domain <> ''").groupBy("domain").agg(F.count("*").alias("papers"))


def hydrate(domains: DataFrame, papers: DataFrame, nodes: DataFrame) -> DataFrame:
    """The domains; if there are none, the legacy ones that papers or nodes refer to."""
    spark = domains.sparkSession
    used = papers.select("domain").unionByName(nodes.select("domain")).where("domain IS NOT NULL").distinct()
    rows = [(k, label, color, None, i) for i, (k, label, color) in enumerate(LEGACY)]
    legacy = spark.createDataFrame(rows, "key string, label string, color string, source string, pos int")
    seeded = legacy.join(used.select(F.col("domain").alias("key")), "key", "left_semi")
    return seeded if domains.isEmpty() else domains


def match_domains(wanted: DataFrame, domains: DataFrame) -> DataFrame:
    """wanted (raw) with ``key``, the domain meant, or null: by key, slug or label, and only if none
    fits by the name without punctuation; of several the first. Equi-joins with a rank."""
    d = domains.select("key", "label", "pos")
    names = [
        (1, X.trim(F.col("raw")), F.col("key")), (1, X.domain_slug(F.col("raw")), F.col("key")), (1, X.key_of(F.col("raw")), X.key_of(F.col("label"))),
        (2, X.domain_name(F.col("raw")), X.domain_name(F.col("label"))), (2, X.domain_name(F.col("raw")), X.domain_name(F.col("key"))),
    ]
    ids = wanted.select("raw").where("trim(raw) <> ''").distinct()
    found = None
    for stage, left, right in names:
        part = ids.select("raw", left.alias("name")).where("name <> ''").join(d.select(right.alias("name"), "key", "pos"), "name").select("raw", F.struct(F.lit(stage).alias("stage"), "pos", "key").alias("hit"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("raw").agg(F.min("hit")["key"].alias("key"))
    return wanted.join(best, "raw", "left")


def ensure_domains(wanted: DataFrame, domains: DataFrame) -> DataFrame:
    """Domains to add for what ``match_domains`` couldn't resolve, each slug once."""
    missing = match_domains(wanted, domains).where("key IS NULL AND trim(raw) <> ''").select(X.domain_slug(F.col("raw")).alias("key"), X.trim(F.col("raw")).alias("label"))
    first = missing.groupBy("key").agg(F.min("label").alias("label"))
    have = domains.agg(F.collect_set("color").alias("used"), F.count("*").alias("n"))
    n = have.collect()[0]  # the colours in use, a palette's worth
    free = [c for c in PALETTE if c not in set(n["used"])] or PALETTE
    place = F.row_number().over(W.orderBy("key")) - 1
    return first.withColumn("pos", (place + n["n"]).cast("int")).withColumn("color", F.get(F.array(*map(F.lit, free)), place % len(free)))


def sparse_domains(domains: DataFrame, counts: DataFrame, pinned: DataFrame) -> DataFrame:
    """Domains with some papers, but fewer than three, that nobody pinned (key)."""
    some = domains.join(counts.select(F.col("domain").alias("key"), "papers"), "key").where((F.col("papers") > 0) & (F.col("papers") < SPARSE))
    return some.join(pinned.select("key"), "key", "left_anti")


def pick_merges(proposed: DataFrame, sparse: DataFrame, domains: DataFrame, protected: DataFrame) -> DataFrame:
    """Proposed merges (pos, from, into) to carry out: out of a sparse, unprotected domain, into one that
    exists and is not itself to be merged (valid or not), each domain once, in order."""
    keys = domains.select("key")
    rows = proposed.where("from <> '' AND into <> '' AND from <> into")
    rows = rows.join(keys.withColumnRenamed("key", "into"), "into", "left_semi").join(keys.withColumnRenamed("key", "from"), "from", "left_semi")
    rows = rows.join(sparse.select(F.col("key").alias("from")), "from", "left_semi").join(protected.select(F.col("key").alias("from")), "from", "left_anti")
    rows = rows.join(proposed.select(F.col("from").alias("into")).where("into IS NOT NULL").distinct(), "into", "left_anti")
    first = F.row_number().over(W.partitionBy("from").orderBy("pos"))
    return rows.withColumn("_n", first).where("_n = 1").select("pos", "from", "into")


def worth_consolidating(domains: DataFrame, sparse: DataFrame) -> bool:
    return domains.count() >= LEAST_FIELDS and not sparse.isEmpty()


def repoint(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """Papers or nodes with their domain replaced by what it was merged into."""
    to = merges.select(F.col("from").alias("domain"), "into")
    return rows.join(to, "domain", "left").withColumn("domain", F.coalesce("into", "domain")).drop("into").select(*rows.columns)


def rename(domains: DataFrame, key: str, label: str) -> DataFrame:
    """A new label, the key as it was; it is the user's from now on."""
    return mark_owned(domains.withColumn("label", F.when(F.col("key") == key, F.lit(label)).otherwise(F.col("label"))), [key])


def mark_owned(domains: DataFrame, keys: list[str]) -> DataFrame:
    return domains.withColumn("source", F.when(F.col("key").isin(*keys), F.lit("user")).otherwise(F.col("source")))


def owned(domains: DataFrame) -> DataFrame:
    return domains.where("source = 'user'").select("key")


def remove(domains: DataFrame, key: str) -> DataFrame:
    return domains.where(F.col("key") != key)


def with_labels(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """Rows with domain_label and domain_color; legacy domains are known, others Unclassified."""
    legacy = rows.sparkSession.createDataFrame(LEGACY, "domain string, _label string, _color string")
    joined = rows.join(domains.select(F.col("key").alias("domain"), F.col("label").alias("_l"), F.col("color").alias("_c")), "domain", "left").join(F.broadcast(legacy), "domain", "left")
    return joined.withColumn("domain_label", F.coalesce("_l", "_label", F.lit("Unclassified"))).withColumn("domain_color", F.coalesce("_c", "_color", F.lit(DEFAULT_COLOR))).drop("_l", "_c", "_label", "_color")
