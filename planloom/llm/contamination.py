"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are partitioned by their number of shingles into (u/2, u]. For each partition a document
is seen as windows of 2u shingles, u apart, so every passage of up to u shingles lies whole in one
of them, and the Jaccard similarity of an item with the window that holds a share t of it is at
least t u/2 / (2u + u/2 (1 - t)) however long the document is. The number of minima that a window
is signed with follows from that bound and the wanted recall: one equal minimum makes a candidate.
A candidate is then verified by the share of the item's shingles in the whole document.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, mix64, packs, texts_of
from .shingles import Shingler


@dataclass(frozen=True)
class Search:
    """`most_chars` bounds the test items in memory at once (some 5 bytes a character, for shingles and
    minima); more are searched block by block, each in a pass of its own over the documents."""

    threshold: float = 0.8
    recall: float = 0.9999
    most_chars: int = 32_000_000


@dataclass
class Part:
    """The items of one size partition and their minima: of each of the `a` functions the sorted
    values, and the items that they belong to."""

    size: int
    a: np.ndarray
    b: np.ndarray
    values: list[np.ndarray]
    items: list[np.ndarray]


class Items:
    def __init__(self, texts: list[str], search: Search):
        h, begin = Shingler(short=False).of(texts)
        self.shingles = [np.unique(h[lo:hi]) for lo, hi in zip(begin[:-1], begin[1:], strict=True)]
        sizes = np.array([len(x) for x in self.shingles])
        self.parts: list[Part] = []
        t = search.threshold
        for power in sorted({math.ceil(math.log2(n)) for n in sizes.tolist() if n}):
            u = 1 << power
            mine = [i for i, n in enumerate(sizes.tolist()) if n and math.ceil(math.log2(n)) == power]
            jaccard = t * u / 2 / (2 * u + u / 2 * (1 - t))
            k = math.ceil(math.log(1 - search.recall) / math.log(1 - jaccard))
            seeds = mix64(np.arange(2 * k, dtype=np.uint64) + np.uint64(u << 20))
            a, b = (seeds[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[k:] >> np.uint64(32)).astype(np.uint32)
            values, items = [], []
            for x, y in zip(a, b, strict=True):
                least = np.array([((self.shingles[i] >> np.uint64(32)).astype(np.uint32) * x + y).min() for i in mine], np.uint32)
                order = np.argsort(least, kind="stable")
                values.append(least[order])
                items.append(np.array(mine)[order])
            self.parts.append(Part(u, a, b, values, items))

    def candidates(self, h: np.ndarray, begin: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs with an equal minimum in some window."""
        found: set[tuple[int, int]] = set()
        n = np.diff(begin)
        full = np.flatnonzero(n)
        if not len(full):
            return found
        x = (h >> np.uint64(32)).astype(np.uint32)
        for p in self.parts:
            blocks = -(-n[full] // p.size)
            text = np.repeat(full, blocks)
            starts = begin[text] + (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * p.size
            joins = np.flatnonzero(text[1:] == text[:-1])
            for a, b, values, items in zip(p.a, p.b, p.values, p.items, strict=True):
                least = np.minimum.reduceat(x * a + b, starts)
                window = least.copy()
                window[joins] = np.minimum(least[joins], least[joins + 1])
                lo = np.searchsorted(values, window, "left")
                hit = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == window)
                for w in hit.tolist():
                    hi = np.searchsorted(values, window[w], "right")
                    found.update((int(text[w]), int(i)) for i in items[lo[w] : hi])
        return found

    def leaks(self, shingler: Shingler, texts: list[str], threshold: float) -> list[tuple[int, int, int, int]]:
        """(text, item, shared shingles, shingles of the item) where the shared share reaches the threshold."""
        h, begin = shingler.of(texts)
        out = []
        for t, i in sorted(self.candidates(h, begin)):
            item = self.shingles[i]
            shared = int(np.isin(item, h[begin[t] : begin[t + 1]]).sum())
            if shared >= threshold * len(item):
                out.append((t, i, shared, len(item)))
        return out


def item_blocks(items: DataFrame, search: Search, id_col: str, text_col: str) -> Iterator[tuple[list, Items]]:
    rows = items.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / search.most_chars))
    for i in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == i)
        got = sorted(((r["k"], r["t"] or "") for r in part.collect()), key=lambda x: (x[0] is None, x))
        yield [k for k, _ in got], Items([t for _, t in got], search)


def contaminated(docs: DataFrame, items: DataFrame, search: Search | None = None, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and test item of which it holds `threshold` of the 5-word shingles:
    id_col, item_id, n_shared, item_shingles, containment.

    Items of fewer than five words have no shingle and match nothing; null and empty texts match
    nothing. Repeated documents and repeated items each give their rows; null ids stay null.
    """
    search = search or Search()
    spark = docs.sparkSession
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_id}` {items.schema[item_id].dataType.simpleString()}, n_shared int, item_shingles int, containment double"
    item_type = items.select(item_id).schema
    base = docs.select(F.col(id_col).alias("_k"), F.col(text_col).alias("_t"))
    out = None
    for names, block in item_blocks(items, search, item_id, item_text):
        shared = spark.sparkContext.broadcast((names, block))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, block = shared.value
            shingler = Shingler(short=False)
            for b in packs(batches, "_t"):
                got = block.leaks(shingler, texts_of(b, "_t"), search.threshold)
                if got:
                    t, i, s, n = (np.array(x) for x in zip(*got, strict=True))
                    kinds = pa.int64() if item_type[0].dataType.simpleString() == "bigint" else None
                    columns = [col(b, "_k").take(pa.array(t)), pa.array([names[x] for x in i.tolist()], kinds), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(s / n)]
                    yield pa.RecordBatch.from_arrays(columns, [id_col, item_id, "n_shared", "item_shingles", "containment"])

        part = base.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, search: Search | None = None, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that hold a test item, as `contaminated` finds them."""
    search = search or Search()
    for _, block in item_blocks(items, search, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            shingler = Shingler(short=False)
            for b in packs(batches, text_col):
                clean = np.ones(b.num_rows, bool)
                clean[[t for t, *_ in shared.value.leaks(shingler, texts_of(b, text_col), search.threshold)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
