"""What the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, scratch_dir  # noqa: F401  for the operators here

#: The tokenizer that the packing operators use unless told otherwise.
DEFAULT_TOKENIZER = "word_bpe_49k.json"


def documents_of(df: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text as string, and the columns named; whatever else df has stays out, so
    that no extra column can clash with one that an operator makes."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
_ARROW |= {f"array<{k}>": pa.list_(v) for k, v in _ARROW.items()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of flat DDL, without a session, so that workers can use it."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (field.split() for field in ddl.split(","))])


def arrow_batch(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def crc_mod(column: str, n: int):
    """crc32(column as text) mod n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


#: What a worker process remembers between tasks, by owner, and how to drop it.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remember(owner: str, forget: Callable[[], None]) -> None:
    _REMEMBERED[owner] = forget


def forget_others(owner: str = "") -> None:
    """Drop what other operators' steps have left in this worker's memory; they can work it out again."""
    for other in [o for o in _REMEMBERED if o != owner]:
        _REMEMBERED.pop(other)()


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut small, so that no more than some rows' texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def grouped_blocks(batches: Iterator[pa.RecordBatch], key: str, max_rows: int, max_bytes: int = 64_000_000) -> Iterator[tuple[object, int, pa.Table]]:
    """From batches whose rows of a key stand side by side: (key, number of the block in its key,
    rows). A key's rows are given in blocks within both limits (but of one row at least), so what a
    task holds stays bounded however many rows a key has."""
    held: list[pa.RecordBatch] = []
    rows = size = block = 0
    current: object = None
    started = False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key))
        codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        bounds = [0, *((codes[1:] != codes[:-1]).nonzero()[0] + 1).tolist(), batch.num_rows]
        per_row = max(1, batch.nbytes // batch.num_rows)
        step = max(1, min(max_rows, max_bytes // per_row))
        for a, b in zip(bounds, bounds[1:]):
            value = keys[a].as_py()
            if not started or value != current:
                if held:
                    yield current, block, pa.Table.from_batches(held)
                held, rows, size, block, current, started = [], 0, 0, 0, value, True
            for at in range(a, b, step):
                part = batch.slice(at, min(step, b - at))
                if held and (rows + part.num_rows > max_rows or size + per_row * part.num_rows > max_bytes):
                    yield current, block, pa.Table.from_batches(held)
                    held, rows, size, block = [], 0, 0, block + 1
                held.append(part)
                rows += part.num_rows
                size += per_row * part.num_rows
    if held:
        yield current, block, pa.Table.from_batches(held)
