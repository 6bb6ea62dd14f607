"""Packed token matrices by best-fit decreasing.

A segment tree over the possible amounts of free room finds the fullest bin that a piece still fits
into in log2(room) steps. Groups are drawn at random as for first-fit packing; here the ids travel
with their pieces, and each finished sequence is one row of the matrix.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DEFAULT_TOKENIZER, arrow_batch, arrow_schema, forget_others, grouped_blocks
from .packing import END_ID, SEQUENCE_TOKENS, cut_documents, with_group
from .tokens import tokenizer_path, vocabulary_size

#: Documents in a group, in the mean.
GROUP_DOCUMENTS = 2048
#: What a task holds at once of a group.
BLOCK_PIECES, BLOCK_BYTES = 8_192, 16_000_000

SEQUENCES = (
    "sequence_id long, n_tokens int, n_pieces int, id_bytes int, ids binary, ids_crc32 long, "
    "cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, starts array<long>, padded_to int"
)


class CapacityTree:
    """How many bins have each amount of free room; finds the least room that is enough."""

    def __init__(self, capacity: int):
        self._leaves = 1 << math.ceil(math.log2(capacity + 1))
        self._count = [0] * (2 * self._leaves)

    def add(self, room: int, by: int = 1) -> None:
        at = self._leaves + room
        while at:
            self._count[at] += by
            at >>= 1

    def least(self, needed: int) -> int | None:
        """The smallest room of at least ``needed`` that a bin has."""
        count, at = self._count, self._leaves + needed
        if count[at]:
            return needed
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self._leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self._leaves
            at >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece; among equally full bins the last filled is taken."""
    tree, bins_of, used = CapacityTree(capacity), [[] for _ in range(capacity + 1)], 0
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        room = tree.least(n)
        if room is None:
            place, room, used = used, capacity, used + 1
        else:
            place = bins_of[room].pop()
            tree.add(room, -1)
        out[i] = (place, capacity - room)
        if room > n:
            bins_of[room - n].append(place)
            tree.add(room - n)
    return out


def packed_matrices(
    documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, room: int = SEQUENCE_TOKENS, end_id: int = END_ID, per_group: int = GROUP_DOCUMENTS, padded: bool = False
) -> DataFrame:
    """Sequences of at most ``room`` token ids, one row each.

    ids: the row of the matrix, little-endian, of ``id_bytes`` bytes each, the same in all rows (2 if
    the tokenizer's vocabulary and ``end_id`` fit, else 4). If ``padded``, every row has ``room`` ids,
    of which those from ``n_tokens`` on are 0, so that the rows of a file lie side by side as one
    matrix; else ``padded_to`` is the length to pad it to when it is loaded. cu_seqlens: 0 and
    the end of each piece; position_resets: where positions start at 0 again; doc_ids and starts:
    which document each piece is from, and how many of that document's ids come before it.

    A document is the ids of its whole text (null: empty) and ``end_id``; longer ones are cut into
    pieces of ``room`` and lose nothing. Of pieces of a length the least doc_id and start come first. Copies and repeated doc_ids are all kept, a null doc_id
    stays null, extra columns are ignored, and an empty table gives an empty one.
    """
    groups = max(1, math.ceil(documents.count() / per_group))
    pieces = with_group(cut_documents(documents, tokenizer, room, end_id, with_ids=True), groups)
    fields = arrow_schema(SEQUENCES)
    kind = "<u2" if max(vocabulary_size(tokenizer_path(tokenizer)) - 1, end_id) <= 0xFFFF else "<u4"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for group, block, table in grouped_blocks(batches, "group", BLOCK_PIECES, BLOCK_BYTES):
            lengths, ids, wide, doc_ids, starts = (table.column(c).to_pylist() for c in ("length", "ids", "wide", "doc_id", "start"))
            bins: dict[int, list[tuple[int, int]]] = {}
            for i, (place, offset) in enumerate(best_fit_decreasing(lengths, room)):
                bins.setdefault(place, []).append((offset, i))
            rows = []
            for place, members in sorted(bins.items()):
                members = [i for _, i in sorted(members)]
                parts = [np.frombuffer(ids[i], "<u4" if wide[i] else "<u2").astype(kind) for i in members]
                row = np.concatenate(parts)
                ends = np.cumsum([lengths[i] for i in members]).tolist()
                rows.append(
                    (group * (1 << 36) + block * (1 << 20) + place, len(row), len(members), row.itemsize, row.tobytes(), zlib.crc32(row.astype("<u4").tobytes()))
                    + ([0, *ends], [0, *ends[:-1]], [doc_ids[i] for i in members], [starts[i] for i in members], room)
                )
                if len(rows) == 256:
                    yield arrow_batch(zip(*rows), fields)
                    rows = []
            if rows:
                yield arrow_batch(zip(*rows), fields)

    # no task with more than some 32 groups; below that the session's own number, which may be merged at run time
    usual = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = [math.ceil(groups / 32)] if groups > 32 * usual else []
    rows = pieces.repartition(*most, "group").sortWithinPartitions("group", F.desc("length"), "doc_id", "start", "ids_crc32").mapInArrow(pack, SEQUENCES)
    if padded:
        rows = rows.withColumn("ids", F.call_function("rpad", "ids", F.lit(room * np.dtype(kind).itemsize), F.lit(b"\0")))
    return rows


def write_matrices(documents: DataFrame, path: str, **options) -> None:
    """Write the packed sequences as Parquet, each row padded to the same length and width."""
    packed_matrices(documents, padded=True, **options).write.parquet(path)


def load_matrix(ids: list[bytes], room: int = SEQUENCE_TOKENS) -> np.ndarray:
    """Padded rows as one (rows, room) matrix."""
    joined = b"".join(ids)
    return np.frombuffer(joined, "<u2" if len(joined) == 2 * room * len(ids) else "<u4").reshape(len(ids), room)


def position_ids(position_resets: list[int], n_tokens: int) -> np.ndarray:
    """The position of every id in its piece."""
    at = np.arange(n_tokens)
    return at - np.repeat(position_resets, np.diff([*position_resets, n_tokens]))
