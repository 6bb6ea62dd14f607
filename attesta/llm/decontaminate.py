"""Benchmark decontamination by winnowing.

Of every ``WINDOW_WORDS - K + 1`` neighbouring k-grams the one with the least hash is kept, on both
sides; so any run of ``WINDOW_WORDS`` words that a document shares with an item has a kept k-gram
in common with it. Fingerprints are joined in two steps. A table of bits, of a fixed size however
large the benchmark is, tells which kept k-grams of a document can be the benchmark's; around those a
hit is extended to the windows that hold the k-gram, and these are joined with the benchmark's
windows on 128-bit hashes. Neither the benchmark nor what is found of it is ever on the driver or
whole in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, documents_of, forget_others, materialize, parts
from .line_dedup import row_hash

#: An item's window, in words.
WINDOW_WORDS = 10
#: Words in a k-gram.
K = 5
#: The table of bits has 2 ** FILTER_BITS of them: 2 MB. A larger benchmark only makes it less telling.
FILTER_BITS = 24
#: Windows of an item that are sent on together.
ROWS_AT_ONCE = 20_000

#: Lower-cases A-Z and blanks all ASCII but letters and digits; other bytes belong to words.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_BASE = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words."""
    n = len(hashes) - k + 1
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_BASE)
        out += hashes[j : j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the k-grams that are the least in some run of ``window``; ties are all kept, so
    what is kept in a run depends on that run alone."""
    n = len(grams) - window + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least = grams[:n].copy()
    for j in range(1, window):
        np.minimum(least, grams[j : j + n], out=least)
    most = np.zeros(len(grams), np.uint64)
    for j in range(window):
        np.maximum(most[j : j + n], least, out=most[j : j + n])
    return np.flatnonzero(most == grams)


def _window_hash(words: list[bytes]) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(words))


def fingerprints_of(words: list[bytes], hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are kept for windows of ``size`` words. A short
    window is a k-gram of its own; sizes do not share hashes."""
    if size < WINDOW_WORDS:
        grams = _grams(hashes, size) if len(words) >= size else np.zeros(0, np.uint64)
        return np.arange(len(grams)), grams ^ np.uint64(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    if len(words) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = _grams(hashes, K)
    at = winnow(grams, size - K + 1)
    return at, grams[at]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """size int, slot long, hash binary, item string: a row for each fingerprint kept of an item
    (slot: its place among 2 ** 62) and for each window (hash, item; an item_id of null is '')."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    schema = "size int, slot long, hash binary, item string"
    fields = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in parts(batches, 16):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                size = min(WINDOW_WORDS, len(words))
                slots = np.unique(fingerprints_of(words, _word_hashes(words), size)[1] >> np.uint64(2)).astype(np.int64)
                for at in range(0, len(slots), ROWS_AT_ONCE):
                    some = slots[at : at + ROWS_AT_ONCE]
                    yield pa.RecordBatch.from_arrays([pa.array([size] * len(some), pa.int32()), pa.array(some), pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.string())], schema=fields)
                for at in range(0, len(words) - size + 1, ROWS_AT_ONCE):
                    found = list({_window_hash(words[i : i + size]) for i in range(at, min(at + ROWS_AT_ONCE, len(words) - size + 1))})
                    yield arrow_batch([[size] * len(found), [None] * len(found), found, [item] * len(found)], fields)

    return items.mapInArrow(cut, schema)


def _filter_of(windows: DataFrame, bits: int) -> tuple[list[int], np.ndarray]:
    """The sizes of windows, ten at most, and the table of bits. The driver gets 2 ** bits of these
    at most, put together by the tasks."""
    place = F.shiftrightunsigned("slot", 62 - bits)
    words = windows.where("slot IS NOT NULL").select("size", F.shiftrightunsigned(place, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits"), F.collect_set("size").alias("sizes")).collect()
    table = np.zeros(max(1, 1 << bits - 6), np.int64)
    for r in found:
        table[r["word"]] = r["bits"]
    return sorted({size for r in found for size in r["sizes"]}), table.view(np.uint64)


def candidates_of(words: list[bytes], sizes: list[int], table: np.ndarray, bits: int) -> dict[bytes, tuple[int, list[int]]]:
    """The windows around the fingerprints that can be the benchmark's: hash to size and starts."""
    out: dict[bytes, tuple[int, list[int]]] = {}
    if not words or not sizes:
        return out
    hashes = _word_hashes(words)
    for size in sizes:
        at, grams = fingerprints_of(words, hashes, size)
        place = grams >> np.uint64(64 - bits)
        at = at[(table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)]
        if not len(at):
            continue
        reach = size - K if size == WINDOW_WORDS else 0
        starts = np.unique((at[:, None] - np.arange(reach + 1)).ravel())
        for i in starts[(starts >= 0) & (starts <= len(words) - size)].tolist():
            out.setdefault(_window_hash(words[i : i + size]), (size, []))[1].append(i)
    return out


_CANDIDATES = "doc_id long, row long, n_words long, hash binary, size int, starts array<int>"


def _candidates(documents: DataFrame, sizes: list[int], table: np.ndarray, bits: int) -> DataFrame:
    """A row for each document (hash null) and one for each window that can be the benchmark's."""
    sent = documents.sparkSession.sparkContext.broadcast((sizes, table))
    fields = arrow_schema(_CANDIDATES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in parts(batches, 64):
            rows = []
            for doc_id, text, row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = words_of(text)
                rows.append((doc_id, row, len(words), None, None, None))
                rows.extend((doc_id, row, None, h, size, starts) for h, (size, starts) in candidates_of(words, *sent.value, bits).items())
            if rows:
                yield arrow_batch(zip(*rows), fields)

    return documents_of(documents).withColumn("row", row_hash()).mapInArrow(scan, _CANDIDATES)


def _found(documents: DataFrame, benchmark: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """The candidates, and those windows of them that are the benchmark's: doc_id, row, size, starts,
    item. Copies of a row are one before the join; in it each hash has one row for an item on the
    benchmark's side, so a window that very many documents hold is only a long run of their rows,
    which adaptive execution splits."""
    windows = materialize(benchmark_windows(benchmark), "benchmark-windows")
    seen = materialize(_candidates(documents, *_filter_of(windows, bits), bits), "candidates")
    own = seen.where("hash IS NOT NULL").groupBy("doc_id", "row", "hash").agg(F.first("size").alias("size"), F.first("starts").alias("starts"))
    items = windows.where("hash IS NOT NULL").select(F.col("hash").alias("of"), "item").distinct()
    return seen, own.join(items, F.col("hash") == F.col("of")).select("doc_id", "row", "hash", "size", "starts", "item")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The documents, all columns, in which no window of the benchmark occurs. Null and empty texts
    stay; rows of one doc_id are judged by their texts; a text of any length is read whole."""
    _, found = _found(documents, benchmark, filter_bits)
    hit = materialize(found.select(F.col("doc_id").alias("__hit_id"), F.col("row").alias("__hit_row")).distinct(), "contaminated")
    rows = documents.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("__id"), row_hash(F.col("text").cast("string")).alias("__row"))
    clean = rows.join(hit, rows["__id"].eqNullSafe(hit["__hit_id"]) & (rows["__row"] == hit["__hit_row"]), "left_anti")
    return clean.select("doc.*")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hit windows of a document as runs of words, joined where they touch."""
    fields = arrow_schema(_RUNS)
    for batch in batches:
        starts, ends = [], []
        for windows in batch.column(2).to_pylist():
            a = np.concatenate([np.asarray(w["starts"], np.int64) for w in windows])
            b = np.concatenate([np.asarray(w["starts"], np.int64) + w["size"] for w in windows])
            order = np.argsort(a, kind="stable")
            a, reached = a[order], np.maximum.accumulate(b[order])
            new = np.concatenate(([True], a[1:] > reached[:-1]))
            starts.append(a[new].tolist())
            ends.append(reached[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(a) - 1]))].tolist())
        yield arrow_batch([batch.column(0), batch.column(1), starts, ends, batch.column(3).to_pylist()], fields)


_RUNS = "doc_id long, row long, hit_starts array<int>, hit_ends array<int>, items array<string>"


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, row, n_words, hit_starts, hit_ends (word positions of the hit runs), items.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters beyond ASCII.
    An item's windows are its runs of ``WINDOW_WORDS`` words; an item of fewer words, but not none, is
    one window. Every occurrence of a window in a document is hit, however long the text. ``items``:
    the ids, as strings, of the items with occurring windows, distinct and sorted (a null item_id is
    ''); ``row`` is a hash of the text. One row per document row, repeated ones too; a null text has
    no words; extra columns are ignored; an empty benchmark hits nothing and an empty documents table
    gives an empty one.
    """
    seen, found = _found(documents, benchmark, filter_bits)
    # sets, so that a window of many items is one
    hits = found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("size", "starts")).alias("windows"), F.sort_array(F.collect_set("item")).alias("items"))
    runs = hits.mapInArrow(_joined, _RUNS).withColumnsRenamed({"doc_id": "d", "row": "r"})
    base = seen.where("hash IS NULL").select("doc_id", "row", "n_words")
    both = base.join(runs, base["doc_id"].eqNullSafe(runs["d"]) & (base["row"] == runs["r"]), "left")
    none = F.array().cast("array<int>")
    return both.select(
        "doc_id", "row", "n_words", F.coalesce("hit_starts", none).alias("hit_starts"), F.coalesce("hit_ends", none).alias("hit_ends"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )
