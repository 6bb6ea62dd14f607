"""Near-duplicate documents by SimHash fingerprints, found through pigeonhole blocks.

A fingerprint's 64 bits are split into blocks. Two fingerprints that differ in at most ``distance``
bits agree on all but ``distance`` of the blocks, so they share the key made of some choice of the
other blocks; rows are brought together on those keys and the Hamming distance decides. Equal
fingerprints are one row from the start. A key with many fingerprints is not compared all with all:
its free bits are split into blocks again, and so on until few enough bits are free. What a key
gives back is a spanning forest of its links, never all pairs, and connected components are found
by rounds of star contraction on these edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, documents_of, forget_others, materialize, parts
from .line_dedup import row_hash

#: Words in a shingle, the hash's seed, and the bits that linked fingerprints may differ in.
SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 2
#: A key's fingerprints are compared directly up to this many; beyond, the key is split further.
RUN_LIMIT = 1024
#: Blocks at the first level; later levels split the free bits into distance + 1 blocks.
BLOCKS = 5
#: Splitting ends where so few bits are free that 2 ** MIN_FREE fingerprints can share a key at most.
MIN_FREE = 10


def fingerprint_of(text: str | None, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text, unsigned. A bit is 1 if more than half of the shingles'
    hashes have it; without words the fingerprint is 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= words_in_shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: n - words_in_shingle + 1].tolist()
    stops = (ends[words_in_shingle - 1 :] - 1).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * count > len(hashes)).tolist()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), fp (the fingerprint as a signed long). A null text is an
    empty one."""
    schema = "doc_id long, row long, fp long"
    fields = arrow_schema(schema)

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in parts(batches):
            found = [_signed(fingerprint_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int64())], schema=fields)

    return documents_of(documents).withColumn("row", row_hash()).mapInArrow(fingerprint, schema)


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    """bits cut into parts of nearly equal size."""
    at = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(at, at[1:])]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def key_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """The bits of each first-level key."""
    parts = _blocks(list(range(64)), blocks)
    return [_mask(sum(chosen, [])) for chosen in combinations(parts, blocks - distance)]


def finer_masks(mask: int, distance: int = DISTANCE) -> list[int]:
    """The keys that split a key: its bits and one of distance + 1 blocks of the others."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | _mask(part) for part in _blocks(free, distance + 1)]


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """fp, mask, key: a row for each key of a fingerprint."""
    keys = F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks))
    return fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.mask", "k.key")


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among fps (uint64, distinct): breadth first, each unvisited
    fingerprint compared with the remaining ones at once."""
    left, edges = fps, []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at, front = front[0], front[1:]
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                new = left[near]
                edges.extend((int(at), int(x)) for x in new)
                left, front = left[~near], np.concatenate((front, new))
    return edges


def _run_links(distance: int, limit: int):
    """Stream rows (fp, mask, key) sorted by mask and key. Runs of up to ``limit`` fingerprints give
    their edges; rows of longer runs come back as they are (a, b, mask), to be split further."""
    fields = arrow_schema("a long, b long, mask long")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, current, long_run = [], 0, None, False

        def flush():
            if long_run or size < 2:
                return None
            edges = _forest(np.concatenate(held).view(np.uint64), distance)
            return _rows(edges, None) if edges else None

        def _rows(pairs, mask):
            a = np.array([p[0] for p in pairs], np.uint64).view(np.int64)
            b = np.array([p[1] for p in pairs], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array([mask] * len(a), pa.int64())], schema=fields)

        def too_many(fps, mask):
            return pa.RecordBatch.from_arrays([pa.array(fps), pa.array(fps), pa.array([mask] * len(fps), pa.int64())], schema=fields)

        for batch in batches:
            fp, mask, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(fp):
                continue
            change = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = [0, *change.tolist(), len(fp)]
            for a, b in zip(bounds, bounds[1:]):
                if (mask[a], key[a]) != current:
                    if size > 1 and (out := flush()) is not None:
                        yield out
                    held, size, current, long_run = [], 0, (mask[a], key[a]), False
                held.append(fp[a:b])
                size += b - a
                if size > limit and _free_bits(int(mask[a])) > MIN_FREE:
                    yield too_many(np.concatenate(held), int(mask[a]))
                    held, long_run = [], True
        if size > 1 and (out := flush()) is not None:
            yield out

    return links


def _free_bits(mask: int) -> int:
    return 64 - (mask & (1 << 64) - 1).bit_count()


def near_links(fps: DataFrame, distance: int = DISTANCE, limit: int = RUN_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose connected components are those of all pairs
    at most ``distance`` bits apart. fps: column fp, distinct."""

    def linked(keyed: DataFrame, tag: str) -> DataFrame:
        ordered = keyed.select("fp", "mask", "key").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        return materialize(ordered.mapInArrow(_run_links(distance, limit), "a long, b long, mask long"), tag)

    masks = key_masks(distance)
    found = linked(_keyed(fps, masks), "links-1")
    links = [found.where("mask IS NULL").select("a", "b")]
    level = 1
    while masks:
        level += 1
        crowded = found.where("mask IS NOT NULL")
        present = {r["mask"] for r in crowded.select("mask").distinct().collect()}  # of the masks of a level, so few
        masks = [m for m in masks if _signed(m) in present]
        if not masks:
            break
        parts = [(m, finer_masks(m, distance)) for m in masks]
        finer = [_keyed(crowded.where(F.col("mask") == F.lit(_signed(m))).select(F.col("a").alias("fp")), more) for m, more in parts]
        rows = finer[0]
        for other in finer[1:]:
            rows = rows.unionByName(other)
        masks = sorted({x for _, more in parts for x in more})
        found = linked(rows.distinct(), f"links-{level}")
        links.append(found.where("mask IS NULL").select("a", "b"))
    out = links[0]
    for other in links[1:]:
        out = out.unionByName(other)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of an undirected edge list (a, b): the smallest node that it can
    reach, found by alternating large-star and small-star rounds until nothing changes. Each round
    is written out; the driver sees one checksum per round."""
    current = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )

    def star(pairs: DataFrame, both: bool) -> DataFrame:
        # each node u with its neighbours v (large star: all; small star: the smaller ones)
        near = pairs.select("u", "v")
        if both:
            near = near.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        joined = near.join(least, near["u"] == least["n"])
        if both:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def state(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]

    before, now = None, state(current)
    while now != before:
        current = materialize(star(star(current, True), False), "star")
        before, now = now, state(current)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _groups(documents: DataFrame, distance: int, limit: int) -> DataFrame:
    """doc_id, row, fp, component_id."""
    prints = materialize(fingerprints(documents), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(near_links(distinct.select("fp"), distance, limit))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = materialize(rooted.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(of_print, "fp").select("doc_id", "row", "fp", "component_id")


def near_duplicate_groups(documents: DataFrame, distance: int = DISTANCE, limit: int = RUN_LIMIT) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id among the documents that each can reach.

    Fingerprints are linked if they differ in at most ``distance`` bits; a bit that exactly half of
    the shingles have is 0; texts without words have fingerprint 0, which links like any other; a
    text of any length is read whole. One row per input row, so a repeated doc_id is repeated; a
    null text is empty; null doc_ids take part, but a component's id is null only if all its doc_ids
    are. Extra columns are ignored, and an empty table gives an empty one.
    """
    return _groups(documents, distance, limit).select("doc_id", "fp", "component_id")


def drop_near_duplicates(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The documents, all columns, with one document of each group: that of the smallest doc_id.

    Of rows with the same doc_id and fingerprint one stays, whatever their texts. In a group that has
    only null doc_ids, one row of each fingerprint stays. Only the keys of the rows that go, and the
    texts of rows that are there twice, are moved.
    """
    rows = _groups(documents, distance, RUN_LIMIT).groupBy("doc_id", "row").agg(F.first("fp").alias("fp"), F.first("component_id").alias("component_id"), F.count("*").alias("n"))
    rows = materialize(rows, "grouped-rows")
    chosen = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "fp").agg(F.min("row").alias("chosen"))
    chosen = chosen.select(F.col("doc_id").alias("of_id"), F.col("fp").alias("of_fp"), "chosen")
    judged = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen["of_id"]) & (rows["fp"] == chosen["of_fp"]), "left")
    gone = F.col("chosen").isNull() | (F.col("row") != F.col("chosen"))
    # rows that go, and those that stay but once
    marked = materialize(judged.where(gone | (F.col("n") > 1)).select(F.col("doc_id").alias("__of"), F.col("row").alias("__is"), (~gone).alias("__once")), "duplicates")
    keyed = documents.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("__id"), row_hash(F.col("text").cast("string")).alias("__row"))
    same = F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__row") == F.col("__is"))
    kept = keyed.join(marked, same, "left_anti")
    once = marked.where("__once")
    if not once.isEmpty():
        kept = kept.unionByName(keyed.join(once, same, "left_semi").dropDuplicates(["__id", "__row"]))
    return kept.select("doc.*")
