"""Packing into sequences of bounded length: the shared cutting step, and first-fit decreasing.

First-fit decreasing keeps the bins' free room in the leaves of a tournament tree; every inner node
holds the largest room below it, so the first bin with room for a piece is found, and updated, in
log2(bins) steps. Packing runs independently in groups of documents drawn at random (by a hash of
the piece), which bounds the memory and time of a task whatever the size of the corpus.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DEFAULT_TOKENIZER, arrow_batch, arrow_schema, documents_of, grouped_blocks, materialize, parts
from .tokens import tokenizer_path, word_encoder

SEQUENCE_TOKENS = 4096
#: Ends a document.
END_ID = 2
#: Pieces in a group, in the mean. Large enough for little padding, small enough for one task.
GROUP_PIECES = 8192

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(
    documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, room: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Every document's ids, cut into pieces of at most ``room``.

    A document is the tokenizer's ids of its whole text (null: empty) and then ``end_id``, so it has
    one id at least. It is cut from its start into pieces of exactly ``room``, the last one shorter:
    every id lies in exactly one piece. Rows that share a doc_id are documents of their own; a null
    doc_id stays null. ``with_ids`` adds the pieces' ids, little-endian, as unsigned 16-bit numbers
    if they all fit, else 32-bit (``wide``).
    """
    path = tokenizer_path(tokenizer)
    schema = PIECES + (", wide boolean, ids binary" if with_ids else "")
    fields = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in parts(batches, 1024):
            rows = [[] for _ in fields]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            held = 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(texts)):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, room):
                    piece = ids[4 * start : 4 * (start + room)]
                    row = [doc_id, start, len(piece) // 4, zlib.crc32(piece), total]
                    if with_ids:
                        small = np.frombuffer(piece, "<u4")
                        wide = bool(small.max() > 0xFFFF)
                        row += [wide, piece if wide else small.astype("<u2").tobytes()]
                        held += len(piece)
                    for column, value in zip(rows, row):
                        column.append(value)
                if held > 8_000_000:
                    yield arrow_batch(rows, fields)
                    rows, held = [[] for _ in fields], 0
            yield arrow_batch(rows, fields)

    return documents_of(documents).mapInArrow(cut, schema)


class TournamentTree:
    """Bins of equal capacity; ``place`` puts a piece into the first bin that has room for it."""

    def __init__(self, bins: int, capacity: int):
        self._leaves = 1 << max(0, math.ceil(math.log2(max(1, bins))))
        self._room = [capacity] * (2 * self._leaves)
        self.capacity = capacity

    def place(self, length: int) -> tuple[int, int]:
        """The bin, and where in it the piece starts."""
        room, node, leaves = self._room, 1, self._leaves
        if room[1] < length:
            raise ValueError("no bin has room")
        while node < leaves:
            node *= 2
            if room[node] < length:
                node += 1
        left = room[node]
        room[node] = left - length
        at = node
        while at > 1:
            at >>= 1
            a, b = room[2 * at], room[2 * at + 1]
            most = a if a > b else b
            if room[at] == most:
                break
            room[at] = most
        return node - leaves, self.capacity - left


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece. Lengths are at most the capacity; equal ones go in input order."""
    tree = TournamentTree(len(lengths), capacity)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = tree.place(lengths[i])
    return out


def group_count(pieces: DataFrame, per_group: int) -> int:
    return max(1, math.ceil(pieces.count() / per_group))


def with_group(pieces: DataFrame, groups: int) -> DataFrame:
    """A group at random, but the same for a piece in every attempt. What differs between rows of
    one doc_id is part of the hash, so that a doc_id on very many rows is spread as well."""
    return pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", F.lit(17)), F.lit(groups)).cast("long"))


#: Exact copies of a piece share a hash, so a group may be larger than the mean; such a group is
#: taken in blocks of this many pieces, each with sequences of its own.
BLOCK_PIECES = 32_768


def pack_first_fit(
    documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, room: int = SEQUENCE_TOKENS, end_id: int = END_ID, per_group: int = GROUP_PIECES
) -> DataFrame:
    """Pack documents into sequences of at most ``room`` tokens by first-fit decreasing.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Pieces in a
    sequence lie side by side from offset 0. Sequence ids are unique, with gaps between groups.
    Null and empty texts are documents of one token. Copies and repeated doc_ids are all kept, extra
    columns are ignored, an empty table gives an empty table, and a text of any length is cut.
    Only lengths and checksums are shuffled, never ids.
    """
    pieces = materialize(cut_documents(documents, tokenizer, room, end_id), "pieces")
    groups = group_count(pieces, per_group)
    schema = PIECES + ", sequence_id long, offset long"
    fields = arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, block, table in grouped_blocks(batches, "group", BLOCK_PIECES):
            places = first_fit_decreasing(table.column("length").to_pylist(), room)
            first = group * (1 << 36) + block * (1 << 20)
            kept = [table.column(f.name).combine_chunks() for f in list(fields)[:-2]]
            yield arrow_batch([*kept, [first + b for b, _ in places], [o for _, o in places]], fields)

    keyed = with_group(pieces, groups).repartition("group").sortWithinPartitions("group", F.desc("length"), "doc_id", "start", "ids_crc32")
    return keyed.mapInArrow(pack, schema)
