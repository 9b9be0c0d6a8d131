"""Exact removal of long repeated byte strings, by suffix arrays over content-defined shards.

Every window of `length` bytes has a minimiser: the leftmost of its `gram`-byte strings with the
least hash. Equal windows have equal minimisers, so windows are sharded by the minimiser's hash and
a window's copies always meet. Consecutive windows with one minimiser travel together as one block
(2/length of a text's bytes start a block). Blocks whose minimiser occurs once hold no repeat and
go no further; equal blocks are settled by counting their hashes; only different blocks that share a
minimiser are compared byte by byte: each shard gets a suffix array by Larsson-Sadakane refinement,
stopped at `length` bytes, where windows that are one group are repeats.

Two blocks that share a window agree on half a window's bytes to the left of the minimiser or to its
right, so a block whose two halves are both its own goes no further either.

A minimiser with more than `most` different blocks is spread over several shards. Their windows'
sorted fingerprints are then cut at common borders and merged: binary search in the merged order
finds the windows that other shards have too.

Passages of many words are found along the way, from blocks of word windows instead of byte windows;
there equal windows are told by 128 bits of hash, and nothing is removed for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, col, mix64, packs, release, texts_of, written
from .forest import row_key
from .suffixes import refine

BYTE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0xB17E))
PRIME = 0x100000001B3
PRIME_32 = 0x01000193
SLICE = 1 << 22  # longer packs are searched slice by slice
POWERS = 1 << 21  # powers of a base that are kept
CHUNK = 1 << 15  # windows that are searched at once, so few that the processor's cache holds them
U64 = 2**64 - 1


SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
BASES = (PRIME, 0x9E3779B97F4A7C15)
BYTES, WORDS = 0, 1  # what a block is measured in


@dataclass(frozen=True)
class Rule:
    """`length` bytes make a repeat. With `words`, runs of so many words that other rows have too are
    counted as well; `gram` and `word_gram` (powers of two) are the sizes of the minimisers."""

    length: int = 400
    gram: int = 32
    most: int = 512
    shard_bytes: int = 1 << 18
    words: int = 0
    word_gram: int = 8


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram codes (of 32 bits) from each place on, gram a power of two."""
    h, size = x, 1
    while size < gram:
        h = h[:-size] * np.uint32(pow(PRIME_32, size, 1 << 32)) + h[size:]
        size *= 2
    return h


def powers_of(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


@cache
def powers(base: int) -> np.ndarray:
    return powers_of(base, POWERS)


def running(x: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of x[i] base^i up to each place, and base^-i: (sum[b] - sum[a]) * inverse[a] is the hash of
    x[a:b] wherever it lies."""
    n = len(x)
    up, down = (powers(b)[: n + 1] if n < POWERS else powers_of(b, n) for b in (base, pow(base, -1, U64 + 1)))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(x * up[:-1], out=total[1:])
    return total, down


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code of each word of texts laid end to end, and where each text's words begin (one
    more entry at the end). Words are runs of anything but space and \\t..\\r."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    solid = ~SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[off] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = ~solid[:-1]
    after[:-1] = ~solid[1:]
    begin = np.flatnonzero(solid & (before | border[:-1]))
    end = np.flatnonzero(solid & (after | border[1:])) + 1
    total, down = running(BYTE[data], PRIME)
    return mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)), np.searchsorted(begin, off)


def minimisers(x: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The place of each window's minimiser. Grams are ordered by the upper bits of a hash of 32 bits, the
    place in the lower ones; equal hashes leave the choice to the place, whatever the grams are."""
    span = length - gram + 1  # grams in a window
    mask = np.uint32((1 << int(CHUNK + span).bit_length()) - 1)
    least = np.empty(len(x) - length + 1, np.int32)
    for base in range(0, len(least), CHUNK):
        key = gram_hashes(x[base : base + CHUNK + length - 1].astype(np.uint32), gram) & ~mask
        key |= np.arange(len(key), dtype=np.uint32)
        size = 1
        while 2 * size <= span:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        rest = span - size
        key = np.minimum(key[: len(key) - rest], key[rest:]) & mask
        least[base : base + len(key)] = key.view(np.int32) + base
    return least


def blocks_of(x: np.ndarray, off: np.ndarray, length: int, gram: int, halves: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """The blocks of texts laid end to end, as codes: text, start in the text, size, minimiser hash,
    start in x, and hashes of the half windows before and behind the minimiser (0: not within the block)."""
    half = -(-(length - gram) // 2)
    ends = np.unique(np.concatenate([off[:-1], np.maximum(off[1:] - length + 1, off[:-1])]))  # of each text's windows
    for base in range(0, max(0, len(x) - length + 1), SLICE):
        part = x[base : base + SLICE + length - 1]
        least = minimisers(part, length, gram)
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        new[ends[(ends >= base) & (ends < base + len(least))] - base] = True
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(least))) + length - 1
        text = np.searchsorted(off, first + base, "right") - 1
        ok = first + base + length <= off[text + 1]
        text, begin, size, mark = text[ok], first[ok] + base, size[ok], least[first[ok]].astype(np.int64)
        if not len(begin):
            continue
        m = np.zeros(len(mark), np.uint64)
        for k in range(gram):
            m = m * np.uint64(PRIME) + part[mark + k]
        m = mix64(m)
        sides = [np.zeros(0, np.int64)] * 2
        if not halves:
            yield text, begin - off[text], size, m.view(np.int64), begin, *sides
            continue
        total, down = running(part, PRIME)
        sides = []
        for lo, salt in ((mark - half, 1), (mark + gram, 2)):
            inside = (lo >= begin - base) & (lo + half <= begin - base + size)
            lo = np.where(inside, lo, 0)
            sides.append(np.where(inside, mix64((total[np.minimum(lo + half, len(part))] - total[lo]) * down[lo] + m * np.uint64(2 * salt + 1)), np.uint64(0)).view(np.int64))
        yield text, begin - off[text], size, m.view(np.int64), begin, *sides


TABLE = "k binary, unit int, start int, size int, m long, s binary, l int, r int"


def block_table(docs: DataFrame, rule: Rule, id_col: str, text_col: str, marks_only: bool = False) -> DataFrame:
    """The blocks of every text; s is 128 bits of the block's own bytes (or word codes). With
    `marks_only` just m, for counting."""
    base = docs.select(F.unhex(row_key(id_col, text_col)).alias("k"), F.col(text_col).alias("_t"))
    names = [x.split()[0] for x in TABLE.split(", ")]
    low = lambda v: pa.array((v & 0xFFFFFFFF).astype(np.uint32).view(np.int32))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in packs(batches, "_t"):
            off, data = bytes_of(col(b, "_t"))
            kinds = [(BYTES, BYTE[data], off, data.tobytes(), 1, rule.length, rule.gram)]
            if rule.words:
                codes, woff = words_of(data, off)
                kinds.append((WORDS, codes, woff, codes.tobytes(), 8, rule.words, rule.word_gram))
            for unit, x, o, raw, wide, length, gram in kinds:
                for text, start, size, m, at, left, right in blocks_of(x, o, length, gram, not marks_only):
                    m = mix64(m.view(np.uint64) + np.uint64(unit)).view(np.int64)
                    if marks_only:
                        yield pa.RecordBatch.from_arrays([pa.array(m)], ["m"])
                        continue
                    s = [hashlib.blake2b(raw[a * wide : (a + n) * wide], digest_size=16).digest() for a, n in zip(at.tolist(), size.tolist(), strict=True)]
                    own = np.frombuffer(b"".join(s), np.int64)[::2]  # a half that isn't there is like no other
                    columns = [col(b, "k").take(pa.array(text)), pa.array(np.full(len(m), unit, np.int32)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(m), pa.array(s, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*columns, *(low(np.where(v == 0, own, v)) for v in (left, right))], names)

    return base.mapInArrow(run, "m long" if marks_only else TABLE)


def repeated_windows(blocks: list[bytes], rule: Rule) -> list[np.ndarray]:
    """Of each (different) block: the starts of its windows that another window of the shard equals."""
    data = np.frombuffer(b"".join(blocks), np.uint8)
    size = np.array([len(b) for b in blocks], np.int64)
    begin = np.cumsum(size) - size
    first = min(8, rule.length)
    padded = np.concatenate([data, np.zeros(first, np.uint8)])
    keys = np.zeros(len(data), np.uint64)
    for k in range(first):
        keys = (keys << np.uint64(8)) | padded[k : k + len(data)]
    left = np.repeat(begin + size, size) - np.arange(len(data))
    _, rank = refine(keys, first, until=rule.length, room=left)
    real = left >= rule.length
    count = np.bincount(rank[real], minlength=len(data))
    hit = real & (count[rank] > 1)
    return [np.flatnonzero(hit[b : b + s]) for b, s in zip(begin.tolist(), size.tolist(), strict=True)]


def runs_of(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte spans that windows with these sorted starts cover, merged where they touch or overlap."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + length


def fingerprints(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window of `length` codes, from two polynomial hashes."""
    out = []
    for base in BASES:
        total, down = running(x, base)
        out.append(mix64((total[length:] - total[:-length]) * down[: max(0, len(x) - length + 1)]))
    return out[0], out[1]


def places_of(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... n places from each begin."""
    return np.repeat(begin, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


CONTENT = "m long, shard int, shards int, s binary, block binary, k binary, k2 binary, at int, h1 long, h2 long"
MARKS = "s binary, a int, b int, m long, cut int, f1 binary, f2 binary, owner binary, at binary, names binary"
SPAN = "s binary, a int, b int"


def mark_row(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def asked_content(docs: DataFrame, asked: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """The bytes of the blocks that are asked for, and of blocks of words the windows' hashes."""
    texts = docs.select(F.unhex(row_key(id_col, text_col)).alias("k"), F.col(text_col).alias("_t")).join(asked, "k")
    names = [x.split()[0] for x in CONTENT.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int32(), pa.int64(), pa.int64()]

    def batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, kind)) for c, kind in zip(names, kinds, strict=True)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in packs(batches, "_t"):
            off, data = bytes_of(col(b, "_t"))
            raw = data.tobytes()
            lists = col(b, "x")
            x = pa.RecordBatch.from_struct_array(lists.flatten())
            text = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            unit, start, size = (col(x, c).to_numpy() for c in ("unit", "start", "size"))
            mine = np.flatnonzero(unit == BYTES)
            if len(mine):
                some = x.take(pa.array(mine))
                begin = off[text[mine]] + start[mine]
                shards = col(some, "shards")
                shard = [int.from_bytes(s[:4], "little") % n for s, n in zip(col(some, "s").to_pylist(), shards.to_pylist(), strict=True)]
                block = [raw[a : a + n] for a, n in zip(begin.tolist(), size[mine].tolist(), strict=True)]
                yield batch(len(mine), m=col(some, "m"), shard=pa.array(shard, pa.int32()), shards=shards, s=col(some, "s"), block=pa.array(block, pa.binary()))
            mine = np.flatnonzero(unit == WORDS)
            if len(mine):
                codes, woff = words_of(data, off)
                h1, h2 = fingerprints(codes, rule.words)
                n = size[mine].astype(np.int64) - rule.words + 1
                at = places_of(woff[text[mine]] + start[mine], n)
                who = pa.array(np.repeat(mine, n))
                yield batch(len(at), s=col(x, "s").take(who), k=col(b, "k").take(pa.array(np.repeat(text[mine], n))), k2=col(x, "k2").take(who), at=pa.array(places_of(np.zeros(len(n), np.int64), n).astype(np.int32)), h1=pa.array(h1[at].view(np.int64)), h2=pa.array(h2[at].view(np.int64)))

    return texts.mapInArrow(run, CONTENT)


def found_in_shards(content: DataFrame, rule: Rule) -> DataFrame:
    """(s, a, b): the spans of blocks whose windows another block of their minimiser has too."""
    sharded = content.repartition("m", "shard").sortWithinPartitions("m", "shard", "s")
    names = [x.split()[0] for x in MARKS.split(", ")]

    def search(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (_, _, _, s, _), starts in zip(rows, repeated_windows([r[4] for r in rows], rule), strict=True):
            out += [(s, int(a), int(b), None, None, None, None, None, None, None) for a, b in zip(*runs_of(starts, rule.length), strict=True)]
        hot: dict[tuple[int, int], list[tuple]] = {}
        for r in rows:
            if r[2] > 1:
                hot.setdefault((r[0], r[1]), []).append(r)
        for (m, _), group in hot.items():
            cuts = group[0][2]
            prints = [fingerprints(BYTE[np.frombuffer(r[4], np.uint8)], rule.length) for r in group]
            f1, f2 = (np.concatenate([p[i] for p in prints]) for i in (0, 1))
            owner = np.repeat(np.arange(len(group), dtype=np.uint32), [len(p[0]) for p in prints])
            at = np.concatenate([np.arange(len(p[0]), dtype=np.uint32) for p in prints])
            order = np.argsort(f1, kind="stable")
            f1, f2, owner, at = f1[order], f2[order], owner[order], at[order]
            borders = np.searchsorted(f1, np.array([(i << 64) // cuts for i in range(1, cuts)], np.uint64))
            for i, (lo, hi) in enumerate(zip([0, *borders], [*borders, len(f1)], strict=True)):
                who, owned = np.unique(owner[lo:hi], return_inverse=True)  # only the names that this cut needs
                every = b"".join(group[x][3] for x in who.tolist())
                out.append((None, None, None, m, i, f1[lo:hi].tobytes(), f2[lo:hi].tobytes(), owned.astype(np.uint32).tobytes(), at[lo:hi].tobytes(), every))
        if out:
            yield mark_row(out, names)

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for b in batches:
            for r in zip(*(col(b, c).to_pylist() for c in ("m", "shard", "shards", "s", "block")), strict=True):
                if r[:2] != last and size >= rule.shard_bytes:
                    yield from search(rows)
                    rows, size = [], 0
                if not rows or rows[-1][3] != r[3] or rows[-1][0] != r[0]:  # repeated rows fetch a block again
                    rows.append(r)
                    size += len(r[4])
                last = r[:2]
        if rows:
            yield from search(rows)

    marks = written(sharded.mapInArrow(shards, MARKS))

    def merge(group):
        blobs = [[np.frombuffer(x, kind) for x in group[c].to_pylist()] for c, kind in (("f1", np.uint64), ("f2", np.uint64), ("owner", np.uint32), ("at", np.uint32))]
        every = np.sort(np.rec.fromarrays([np.concatenate(blobs[0]), np.concatenate(blobs[1])]), order=("f0", "f1"))
        seen: dict[bytes, list[np.ndarray]] = {}
        for f1, f2, owner, at, who in zip(*blobs, group["names"].to_pylist(), strict=True):
            lo = np.searchsorted(every["f0"], f1, "left")
            hi = np.searchsorted(every["f0"], f1, "right")
            twice = np.flatnonzero(hi - lo > 1)
            twice = twice[[np.count_nonzero(every["f1"][a:b] == f) > 1 for a, b, f in zip(lo[twice], hi[twice], f2[twice], strict=True)]] if len(twice) else twice
            for o in np.unique(owner[twice]).tolist():
                seen.setdefault(who[16 * o : 16 * o + 16], []).append(at[twice[owner[twice] == o]])
        rows = [(s, int(a), int(b)) for s, found in seen.items() for a, b in zip(*runs_of(np.unique(np.concatenate(found)).astype(np.int64), rule.length), strict=True)]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], names=["s", "a", "b"])

    merged = marks.where("cut is not null").select("m", "cut", "f1", "f2", "owner", "at", "names").groupBy("m", "cut").applyInArrow(merge, SPAN)
    return marks.where("s is not null").select("s", "a", "b").unionByName(merged)


def removed_spans(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """(k, spans): for each row key with repeats the spans (unit, a, b): of bytes to remove, and of
    words that another row has too. They may overlap."""
    # the blocks are cut twice, which is cheaper than to keep them all: most occur once. Counts are
    # written before they are joined: then the join deals both sides itself and can split a minimiser
    # that very many windows share
    often = written(block_table(docs, rule, id_col, text_col, marks_only=True).groupBy("m").agg(F.count("*").alias("c")).where("c > 1").select("m"))
    shared = written(block_table(docs, rule, id_col, text_col).join(often, "m"))
    release(often)
    each = written(
        shared.groupBy("m", "s").agg(
            F.count("*").alias("n"), F.min("k").alias("k"), F.max("k").alias("k2"), F.min(F.struct("k", "start", "size", "unit", "l", "r")).alias("at")
        )
    )
    crowd = written(each.groupBy("m").agg(F.count("*").alias("d")).where("d > 1").select("m"))
    # a shared window lies to a half at least on one side of the minimiser
    half = lambda side: F.xxhash64("m", "at.unit", side, F.lit(side))
    crowded = written(each.join(crowd, "m").select("m", "s", "k2", "at.*", half("at.l").alias("hl"), half("at.r").alias("hr")).drop("l", "r"))
    twins = written(crowded.select(F.explode(F.array("hl", "hr")).alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    marked = crowded
    for side in ("hl", "hr"):
        marked = marked.join(twins.select(F.col("h").alias(side), F.lit(True).alias(f"twin_{side}")), side, "left")
    alike = written(marked.where("twin_hl or twin_hr").select("m", "s", "k", "k2", "start", "size", "unit"))
    sizes = written(alike.groupBy("m").agg(F.ceil(F.count("*") / rule.most).cast("int").alias("shards")))
    release(crowd, crowded, twins)
    fetch = alike.join(sizes, "m").select("k", F.struct("unit", "start", "size", "m", "s", "shards", "k2").alias("x"))
    asked = fetch.groupBy("k").agg(F.collect_list("x").alias("x"))  # the blocks of one text
    content = written(asked_content(docs, asked, rule, id_col, text_col))
    release(alike, sizes)

    whole = each.where(F.when(F.col("at.unit") == BYTES, F.col("n") > 1).otherwise(F.col("k") != F.col("k2")))
    cover = found_in_shards(content.where("block is not null").select("m", "shard", "shards", "s", "block"), rule).unionByName(whole.select("s", F.lit(0).alias("a"), F.col("at.size").alias("b")))
    done = [each, content]
    if rule.words:
        windows = content.where("h1 is not null").select("h1", "h2", "k", "k2", "s", "at")
        common = written(windows.groupBy("h1", "h2").agg(F.min("k").alias("k"), F.max("k2").alias("k2")).where("k <> k2").select("h1", "h2"))
        hits = windows.join(common, ["h1", "h2"]).select("s", F.col("at").alias("a"), (F.col("at") + rule.words).alias("b")).distinct()
        cover = cover.unionByName(hits)
        done.append(common)
    cover = written(cover)
    release(*done)
    spans = shared.select("k", "unit", "start", "s").join(cover, "s").select("k", "unit", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    return spans.groupBy("k").agg(F.collect_set(F.struct("unit", "a", "b")).alias("spans"))  # of one text; equal rows count once


def merged_spans(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, with those that touch or overlap made one."""
    order = np.argsort(a, kind="stable")
    a, top = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > top[:-1]
    first = np.flatnonzero(new)
    return a[first], top[np.concatenate([first[1:] - 1, [len(a) - 1]]).astype(np.int64)] if len(a) else top


def remove_repeats(docs: DataFrame, rule: Rule | None = None, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Per row: id_col, n_bytes, n_removed, n_spans, kept_sha256 (n_passage_words, if rule.words; and
    kept, the remaining bytes, if `texts`). A byte goes if a `length`-byte string that covers it also
    starts at another place, in this or any other row's text. n_passage_words counts the words in runs
    of rule.words words that a row with another id or text has too; nothing goes for them.

    Null counts as empty. Shorter texts lose nothing. Repeated rows are copies of each other, so each
    loses all of its bytes if it has `length` at least, but they are one row to n_passage_words. Rows
    with equal ids and different texts are apart; a null id stays null. Other columns of docs, however
    they are called, are not read.
    """
    rule = rule or Rule()
    spans = removed_spans(docs, rule, id_col, text_col)
    base = docs.select(F.unhex(row_key(id_col, text_col)).alias("k"), F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    joined = base.join(spans, "k", "left").select("_id", "_t", *(F.col(f"spans.{c}").alias(c) for c in ("unit", "a", "b")))
    numbers = ["n_bytes", "n_removed", "n_spans"]
    extra = [("n_passage_words", "long", pa.int64())] * bool(rule.words) + [("kept", "binary", pa.binary())] * texts
    names = [id_col, *numbers, "kept_sha256", *(x[0] for x in extra)]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in packs(batches, "_t"):
            out: dict[str, list] = {n: [] for n in names[1:]}
            for t, unit, a, b in zip(texts_of(x, "_t"), *(col(x, c) for c in ("unit", "a", "b")), strict=True):
                raw, gone, n, words = t.encode("utf-8", "surrogatepass"), 0, 0, 0
                kept = raw
                if unit.is_valid:
                    unit, a, b = (v.values.to_numpy() for v in (unit, a, b))
                    lo, hi = merged_spans(a[unit == WORDS], b[unit == WORDS])
                    words = int((hi - lo).sum())
                    lo, hi = merged_spans(a[unit == BYTES], b[unit == BYTES])
                    gone, n = int((hi - lo).sum()), len(lo)
                    kept = b"".join(raw[p:q] for p, q in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)], strict=True))
                row = {"n_bytes": len(raw), "n_removed": gone, "n_spans": n, "kept_sha256": hashlib.sha256(kept).hexdigest(), "n_passage_words": words, "kept": kept}
                for c in out:
                    out[c].append(row[c])
            kinds = [*[pa.int64()] * 3, pa.string(), *(k for _, _, k in extra)]
            yield pa.RecordBatch.from_arrays([col(x, "_id"), *(pa.array(out[c], k) for c, k in zip(names[1:], kinds, strict=True))], names)

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + "".join(f", {n} {kind}" for n, kind, _ in extra)
    return joined.mapInArrow(cut, schema)
