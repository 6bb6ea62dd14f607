"""Line deduplication across documents, by range-partitioned line hashes.

Lines long enough to count are hashed to 128 bits. The rows (hash, document, position) are
range-partitioned on hash *and* document, so that a line that a third of all documents hold is
spread over many tasks, and sorted within each partition; one streaming pass then meets each
line's documents in order and counts them, with no group ever held. What comes back to a document
is a compressed bitmap of the lines it keeps; its text moves only for the last step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, documents_of, forget_others, materialize, parts

#: Keys of fewer code points are never dropped.
MIN_KEY_CHARS = 40
#: Keys found in fewer documents are never dropped.
MIN_DOCUMENTS = 5

_SPACE = " \t\n\v\f\r"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def line_key(line: str) -> str:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(_SPACE).translate(_LOWER)


def row_hash(text: Column | str = "text") -> Column:
    """Tells rows that share a doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def _hashed_lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, row, h1, h2, pos: one row for each line that is long enough."""
    fields = arrow_schema("doc_id long, row long, h1 long, h2 long, pos int")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        forget_others()
        for batch in parts(batches):
            ids, rows, digests, positions = [], [], [], []
            for doc_id, text, row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text is None or len(text) < min_chars:
                    continue
                for pos, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars:
                        key = line.strip(_SPACE)
                        if len(key) >= min_chars:
                            raw = key.encode()
                            # bytes.lower() touches A-Z alone
                            digests.append(xxh3_128_digest(raw.lower()))
                            ids.append(doc_id)
                            rows.append(row)
                            positions.append(pos)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            columns = (ids, rows, np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]), positions)
            yield arrow_batch(columns, fields)

    rows = documents_of(documents).withColumn("row", row_hash())
    return rows.mapInArrow(lines, "doc_id long, row long, h1 long, h2 long, pos int")


def _run_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (h1, h2, doc_id) sorted so: each hash with its count of distinct documents and the
    largest of them (null: only null). The first and last hash of a partition may have more rows
    in the next one, so these partial counts are ``open`` and always given; a document's rows for a
    hash all lie in one partition."""
    fields = arrow_schema("h1 long, h2 long, n long, last long, open boolean")
    carried: tuple | None = None  # the hash at hand: h1, h2, documents, last document, first in the partition
    seen_any = False

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return arrow_batch(zip(*rows), fields)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        null = np.asarray(batch.column(2).is_null())
        doc = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        new_hash = np.ones(n, bool)
        new_hash[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_doc = new_hash.copy()
        new_doc[1:] |= (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])
        if carried and carried[0] == h1[0] and carried[1] == h2[0]:
            new_hash[0] = False
            new_doc[0] = (carried[3] != (None if null[0] else doc[0]))
        starts = np.flatnonzero(new_hash)
        lengths = np.add.reduceat(new_doc.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], n) - 1
        done: list[tuple] = []
        if not new_hash[0]:
            head = int(starts[0]) if len(starts) else n
            count = int(new_doc[:head].sum())
            carried = (carried[0], carried[1], carried[2] + count, None if null[head - 1] else int(doc[head - 1]), carried[4])
        if len(starts):
            if carried:
                if carried[4] or carried[2] >= 2:
                    done.append(carried)
            keep = np.flatnonzero(lengths[:-1] >= 2)
            first_is_open = not seen_any
            if first_is_open and len(starts) > 1 and (not len(keep) or keep[0] != 0):
                keep = np.append(0, keep)
            for i in keep.tolist():
                e = ends[i]
                done.append((int(h1[e]), int(h2[e]), int(lengths[i]), None if null[e] else int(doc[e]), first_is_open and i == 0))
            e = n - 1
            carried = (int(h1[e]), int(h2[e]), int(lengths[-1]), None if null[e] else int(doc[e]), first_is_open and len(starts) == 1)
        seen_any = True
        if done:
            yield batch_of(done)
    if carried:
        yield batch_of([(*carried[:4], True)])


def frequent_lines(hashed: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """h1, h2, keeper: the hashes found in at least ``min_documents`` documents, and the largest."""
    ordered = hashed.select("h1", "h2", "doc_id").repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", F.asc_nulls_first("doc_id"))
    partial = ordered.mapInArrow(_run_counts, "h1 long, h2 long, n long, last long, open boolean")
    complete = partial.where(F.col("open") | (F.col("n") >= min_documents))
    total = complete.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("keeper"))
    return total.where(F.col("n") >= min_documents).select("h1", "h2", "keeper")


def _bitmap(dropped: pd.Series) -> pd.Series:
    """Bits from position 0 to the last dropped line, 1 for a kept line; later lines are kept."""

    def one(positions) -> bytes:
        keep = np.ones(int(max(positions)) + 1, np.uint8)
        keep[np.asarray(positions)] = 0
        return len(keep).to_bytes(4, "little") + zlib.compress(np.packbits(keep).tobytes(), 6)

    return dropped.map(one)


def read_bitmap(bitmap: bytes | None) -> np.ndarray:
    """The keep flags of a bitmap; lines beyond them are kept."""
    if bitmap is None:
        return np.ones(0, np.uint8)
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap[4:]), np.uint8))[: int.from_bytes(bitmap[:4], "little")]


def keep_bitmaps(documents: DataFrame, min_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, row, keep: a compressed bitmap for each document that loses a line. ``row`` is the
    hash of the text, which tells rows that share a doc_id apart."""
    hashed = materialize(_hashed_lines(documents, min_chars), "lines")
    frequent = materialize(frequent_lines(hashed, min_documents), "frequent-lines")
    hits = hashed.join(frequent, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    dropped = hits.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("dropped"))
    return dropped.select("doc_id", "row", F.pandas_udf(_bitmap, "binary")("dropped").alias("keep"))


def with_bitmaps(documents: DataFrame, min_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """All of the documents' own columns in the struct ``doc``, and ``keep`` (null: all lines)."""
    bitmaps = materialize(keep_bitmaps(documents, min_chars, min_documents), "bitmaps")
    rows = documents.select(F.col("doc_id").cast("long").alias("__id"), row_hash(F.col("text").cast("string")).alias("__row"), F.struct("*").alias("doc"))
    match = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__row") == F.col("row"))
    return rows.join(bitmaps, match, "left").select("doc", "keep")


def kept_text(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    """The kept lines joined by newlines; the lines before; the lines dropped."""
    text = text or ""
    if keep is None:
        return text, text.count("\n") + 1, 0
    lines, flags = text.split("\n"), read_bitmap(keep)
    kept = [line for line, flag in zip(lines, flags) if flag] + lines[len(flags) :]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(documents: DataFrame, min_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Drop lines that many documents share, except in the largest doc_id that holds them.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least
    ``min_chars`` code points found in at least ``min_documents`` distinct doc_ids lose all their
    lines, save those in the largest such doc_id. Returns the documents' columns as a struct ``doc``
    with ``keep`` (bitmap), ``kept_text`` (the text left), n_lines and n_dropped.

    A null or empty text is one empty line. Rows that share a doc_id count as one document. A null
    doc_id counts as a document below all others. Extra columns stay inside ``doc``. An empty table
    gives an empty one.
    """
    apply = F.pandas_udf(_apply_bitmaps, "kept_text string, n_lines long, n_dropped long")
    rows = with_bitmaps(documents, min_chars, min_documents)
    return rows.withColumn("out", apply(F.col("doc.text").cast("string"), F.col("keep"))).select("doc", "keep", "out.*")


def _apply_bitmaps(texts: pd.Series, keeps: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([kept_text(t, k) for t, k in zip(texts, keeps)], columns=["kept_text", "n_lines", "n_dropped"])
