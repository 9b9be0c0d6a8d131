"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import release, shared_dir, written  # noqa: F401  (the operators import them from here)

#: Texts are handled in packs of about so many bytes, so numpy's temporaries stay small however
#: many rows Spark puts in an Arrow batch. One longer text is a pack of its own.
PACK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each lengthened until no column of `taken` is called so (in any case)."""
    known, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, from 0) and the UTF-8 bytes of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def packs(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PACK_BYTES, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes in `column`, and `rows` rows, at most; no row is split."""
    for b in batches:
        if not b.num_rows:
            continue
        at = b.schema.get_field_index(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right"))
            hi = min(max(hi, lo + 1), lo + rows)
            yield b.slice(lo, hi - lo)
            lo = hi


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (xor-shift and odd multipliers), elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
