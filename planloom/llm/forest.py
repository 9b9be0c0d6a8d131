"""Near copies: n-gram Jaccard join by a MinHash LSH forest, verified exactly.

Each tree is a prefix trie over `deepest` minima. Prefixes are shortened from there until pairs at the
threshold are found with the wanted recall, and further, to `shallowest`, wherever the shorter
prefix's node still holds few texts: so each trie is cut where its own texts allow.

Many near copies of one text make nodes that all trees share. Such a node's texts are first compared
with one of them. Jaccard distance is a metric, so texts within half the allowed distance of the same
text (a star) are all linked, which needs no comparison between them, and a text too far from it is
linked with none of its star.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, mix64, packs, texts_of, written
from .components import components
from .shingles import Shingler


@dataclass(frozen=True)
class Forest:
    """`trees` prefix tries over signatures of `deepest` minima each. A node of at most `few` texts may
    have a prefix as short as `shallowest`. Pairs of a node of more than `block` texts are compared
    in block pairs, each a task's share of its own."""

    threshold: float = 0.8
    recall: float = 0.9995
    trees: int = 16
    deepest: int = 6
    shallowest: int = 3
    few: int = 8
    block: int = 1024

    def depth(self) -> int:
        """The longest prefix that reaches the recall at the threshold: from the full depth on it is
        shortened until 1 - (1 - threshold^depth)^trees is enough. Depth 1 is the least."""
        d = self.deepest
        while d > 1 and 1 - (1 - self.threshold**d) ** self.trees < self.recall:
            d -= 1
        return d

    def least_equal(self) -> int:
        """Equal minima under which a pair is given up unverified: six standard deviations below what
        a pair at the threshold has on average."""
        k = self.trees * self.deepest
        return int(k * self.threshold - 6 * (k * self.threshold * (1 - self.threshold)) ** 0.5)

    def ratio(self, distance_share: Fraction = Fraction(1)) -> tuple[int, int]:
        """The similarity whose distance is this share of the threshold's, as whole numbers a, b: sets
        reach it if b * shared >= a * union."""
        f = 1 - (1 - Fraction(str(self.threshold))) * distance_share
        return f.numerator, f.denominator


def signatures(h: np.ndarray, begin: np.ndarray, cfg: Forest) -> np.ndarray:
    """Minima of the texts' shingles, big-endian so that byte prefixes sort as the numbers do; a text
    without shingles has the largest values."""
    k = cfg.trees * cfg.deepest
    seeds = mix64(np.arange(2 * k, dtype=np.uint64) + np.uint64(0xF0E5))
    x = (h >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(begin))
    out = np.full((len(begin) - 1, k), 0xFFFFFFFF, ">u4")
    if len(full):
        for i in range(k):
            a, b = np.uint32((int(seeds[2 * i]) >> 32) | 1), np.uint32(int(seeds[2 * i + 1]) >> 32)
            out[full, i] = np.minimum.reduceat(x * a + b, begin[full])
    return out


def row_key(id_col: str, text_col: str) -> Column:
    """Rows with equal ids and texts are the same to everything here."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("\0")), F.lit("\1"), F.coalesce(F.col(text_col), F.lit(""))))


def signed(docs: DataFrame, cfg: Forest, id_col: str, text_col: str) -> DataFrame:
    """k, id, cid (hash of the shingle set; null without any) and sig, per row."""
    base = docs.select(row_key(id_col, text_col).alias("k"), F.col(id_col).alias("id"), F.col(text_col).alias("_t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in packs(batches, "_t"):
            h, begin = shingler.of(texts_of(b, "_t"))
            sig = signatures(h, begin, cfg)
            sets = [hashlib.blake2b(np.unique(h[lo:hi]).tobytes(), digest_size=16).digest() if hi > lo else None for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([col(b, "k"), col(b, "id"), pa.array(sets, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], ["k", "id", "cid", "sig"])

    return base.mapInArrow(run, f"k string, id {docs.schema[id_col].dataType.simpleString()}, cid binary, sig binary")


GROUP = ["t", "p", "i", "j"]


def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of equal GROUP columns in sorted batches."""
    rest: pa.Table | None = None
    for b in batches:
        now = pa.Table.from_batches([b])
        now = (now if rest is None else pa.concat_tables([rest, now])).combine_chunks()
        if not now.num_rows:
            continue
        new = np.zeros(now.num_rows - 1, bool)
        for c in GROUP:
            v = now[c].to_numpy()
            new |= v[1:] != v[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [now.num_rows]])
        for lo, hi in zip(cuts[:-2].tolist(), cuts[1:-1].tolist(), strict=True):
            yield now.slice(lo, hi - lo)
        rest = now.slice(int(cuts[-2]))
    if rest is not None and rest.num_rows:
        yield rest


def likely(g: pa.Table, cfg: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of a group are to be verified in it: those with enough equal minima, of different
    stars and (in a block pair) one text of either block. First the pairs whose whole prefixes agree
    in this tree and in none before; then those that agree nowhere so far, and meet in this node only
    because its prefix is shorter. The second kind may meet in other trees too."""
    k, d = cfg.trees * cfg.deepest, cfg.depth()
    sig = np.frombuffer(b"".join(g["sig"].to_pylist()), ">u4").astype(np.uint32).reshape(-1, k)
    t, i, j = (int(g[c][0].as_py()) for c in ("t", "i", "j"))
    n = len(sig)
    equal = np.zeros((n, n), np.int16)
    earlier, here, ever = (np.zeros((n, n), bool) for _ in range(3))
    for tree in range(cfg.trees):
        agree = np.ones((n, n), bool)
        for c in range(tree * cfg.deepest, (tree + 1) * cfg.deepest):
            same = sig[:, c, None] == sig[None, :, c]
            equal += same
            if c - tree * cfg.deepest < d:
                agree &= same
        ever |= agree
        if tree < t:
            earlier |= agree
        if tree == t:
            here = agree
    pairs = equal >= cfg.least_equal()
    star = g["star"].to_pylist()
    if any(x is not None for x in star):
        ids = {x: k for k, x in enumerate(dict.fromkeys(star))}
        at = np.array([-1 - k if x is None else ids[x] for k, x in enumerate(star)])
        pairs &= at[:, None] != at[None, :]
    if i != j:
        block = g["block"].to_numpy()
        pairs &= block[:, None] != block[None, :]
    np.fill_diagonal(pairs, False)
    return pairs & here & ~earlier, pairs & ~ever


#: Shingles that are compared at once; larger groups (of very long texts) go part by part.
MOST_SHINGLES = 4_000_000


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    ids, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n > 1)  # only these can be in two sets
    place = np.full(len(ids), -1)
    place[shared] = np.arange(len(shared))
    at = place[at]
    who, at = who[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for lo in range(0, len(shared), 4096):  # exact: a part's counts stay far below 2**24
        a, b = np.searchsorted(at, [lo, lo + 4096])
        m = np.zeros((len(sets), min(4096, len(shared) - lo)), np.float32)
        m[who[a:b], at[a:b] - lo] = 1
        both += (m @ m.T).astype(np.int64)
    return both


def linked(g: pa.Table, cfg: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Which of the likely pairs (of either kind) have shingle sets with Jaccard similarity of at least
    the threshold, told in whole numbers."""
    first, other = likely(g, cfg)
    pairs = first | other
    sets = [np.frombuffer(x, np.uint64) for x in g["shingles"].to_pylist()]
    size = np.array([len(x) for x in sets])
    parts = [p for p in np.split(np.arange(len(sets)), np.flatnonzero(np.diff(np.cumsum(size) // max(1, MOST_SHINGLES // 2))) + 1) if len(p)]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for k, p in enumerate(parts):
        for q in parts[k:]:
            if pairs[np.ix_(p, q)].any():
                m = shared_counts([sets[x] for x in (p if p is q else np.concatenate([p, q]))])[: len(p), -len(q) :]
                both[np.ix_(p, q)], both[np.ix_(q, p)] = m, m.T
    a, b = cfg.ratio()
    alike = b * both >= a * (size[:, None] + size[None, :] - both)
    return first & alike, other & alike


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """cid and shingles (the sorted distinct hashes), a row for each row of wanted(k, cid), cids distinct."""
    texts = docs.select(row_key(id_col, text_col).alias("k"), F.col(text_col).alias("_t")).join(wanted, "k")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in packs(batches, "_t"):
            h, begin = shingler.of(texts_of(b, "_t"))
            sets = [np.unique(h[lo:hi]).tobytes() for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([col(b, "cid"), pa.array(sets, pa.binary())], ["cid", "shingles"])

    return texts.mapInArrow(run, "cid binary, shingles binary").dropDuplicates(["cid"])  # repeated rows fetch a text again


def tries(leaves: DataFrame, cfg: Forest) -> DataFrame:
    """(t, p, n, cid): the texts of every cut node with more than one of them.

    Counts are written before they are joined, so that the join deals both sides itself and can
    split a node that many share."""
    d = cfg.depth()
    prefix = lambda k: F.xxhash64("t", F.expr(f"substring(path, 1, {4 * k})"), F.lit(k))
    top = leaves.withColumn("p", prefix(min(cfg.shallowest, d)))
    nodes = written(top.groupBy("t", "p").agg(F.count("*").alias("n")).where("n > 1"))
    shared = top.join(nodes, ["t", "p"])
    if cfg.shallowest >= d:
        return shared.select("t", "p", "n", "cid")
    shared = written(shared)
    low = shared.where(F.col("n") > cfg.few).drop("n", "p").withColumn("p", prefix(d))
    deep = written(low.groupBy("t", "p").agg(F.count("*").alias("n")).where("n > 1"))
    return shared.where(F.col("n") <= cfg.few).select("t", "p", "n", "cid").unionByName(low.join(deep, ["t", "p"]).select("t", "p", "n", "cid"))


NEAR, FAR = 1, 2


def starred(members: DataFrame, classes: DataFrame, docs: DataFrame, cfg: Forest, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Of the nodes with more than cfg.block texts: stars (cid, star), and seen (cid, centre, how), how
    each text lies to its nodes' centres (the least cid of each): NEAR (perhaps linked with some of
    the centre's star) or FAR (with none)."""
    hot = members.where(F.col("n") > cfg.block)
    centres = written(hot.groupBy("t", "p").agg(F.min("cid").alias("centre")))
    asked = written(hot.join(centres, ["t", "p"]).select("cid", "centre").distinct())
    cids = asked.select("cid").unionByName(asked.select(F.col("centre").alias("cid"))).distinct()
    sets = written(shingle_sets(docs, cids.join(classes, "cid").select(F.col("best.k").alias("k"), "cid"), id_col, text_col))
    pairs = asked.join(sets, "cid").join(sets.select(F.col("cid").alias("centre"), F.col("shingles").alias("own")), "centre")
    half, far = cfg.ratio(Fraction(1, 2)), cfg.ratio(Fraction(3, 2))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in packs(batches, "shingles"):
            how = []
            for x, y in zip(*(col(b, c).to_pylist() for c in ("shingles", "own")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int(np.isin(x, y, assume_unique=True).sum())
                union = len(x) + len(y) - both
                how.append(0 if half[1] * both >= half[0] * union else NEAR if far[1] * both >= far[0] * union else FAR)
            yield pa.RecordBatch.from_arrays([col(b, "cid"), col(b, "centre"), pa.array(how, pa.int32())], ["cid", "centre", "how"])

    seen = written(pairs.select("cid", "centre", "shingles", "own").mapInArrow(compare, "cid binary, centre binary, how int"))
    return written(seen.where("how = 0").groupBy("cid").agg(F.min("centre").alias("star"))), seen.where("how > 0")


def dealt_blocks(members: DataFrame, cfg: Forest) -> DataFrame:
    """members(t, p, n, cid) with (i, j, block): each node's texts in blocks, a row for every block that
    one's own meets."""
    blocks = members.withColumn("blocks", F.ceil(F.col("n") / cfg.block).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    return blocks.select("t", "p", "cid", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))


def dealt_stars(hot: DataFrame, stars: DataFrame, seen: DataFrame, cfg: Forest) -> DataFrame:
    """As dealt_blocks, for nodes with stars: a star's texts have blocks of their own, which don't meet
    each other, nor those of texts that are far from the star's centre."""
    centre = hot.groupBy("t", "p").agg(F.min("cid").alias("centre"))
    rows = hot.join(written(centre), ["t", "p"]).join(stars, "cid", "left").join(seen.where(F.col("how") == FAR).select("cid", "centre", F.lit(True).alias("far")), ["cid", "centre"], "left")
    # texts of no star are one part, or two: near the node's centre, and far from it
    part = F.coalesce(F.col("star"), F.when(F.col("far"), F.lit(b"far")).otherwise(F.lit(b"near")))
    rows = written(rows.select("t", "p", "cid", "centre", part.alias("part")))
    parts = rows.groupBy("t", "p", "centre", "part").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / cfg.block).cast("int"))
    before = Window.partitionBy("t", "p").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a few parts a node
    parts = parts.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int"))
    every = parts.groupBy("t", "p").agg(F.collect_list(F.struct("part", "first", "blocks")).alias("every"))
    alone = F.length("part") == 16  # a star
    meets = lambda x: ~(alone & (x["part"] == F.col("part"))) & ~((F.col("part") == F.col("centre")) & (x["part"] == F.lit(b"far"))) & ~((F.col("part") == F.lit(b"far")) & (x["part"] == F.col("centre")))
    plan = parts.join(every, ["t", "p"]).withColumn("others", F.flatten(F.transform(F.filter("every", meets), lambda x: F.sequence(x["first"], x["first"] + x["blocks"] - 1))))
    plan = written(plan.select("t", "p", "part", "first", "blocks", "others"))
    dealt = rows.join(plan, ["t", "p", "part"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    return dealt.select("t", "p", "cid", "block", F.explode("others").alias("o"))


def near_copies(docs: DataFrame, cfg: Forest | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join's two tables. Rows: k (row_key), id and cid (the text's class: equal shingle sets).
    Classes: cid, size, best (struct id, k: the least of its rows), links (other rows, over all
    classes linked with it) and root (the cid that stands for its group: what links connect).

    All pairs of distinct shingle sets with Jaccard similarity >= cfg.threshold are links, found
    with probability cfg.recall at least at the threshold and more above it; none is wrong.
    """
    cfg = cfg or Forest()
    rows = written(signed(docs, cfg, id_col, text_col))
    classes = written(rows.where("cid is not null").groupBy("cid").agg(F.count("*").alias("size"), F.min(F.struct("id", "k")).alias("best"), F.first("sig").alias("sig")))

    width = 4 * cfg.deepest
    leaves = classes.select("cid", "sig", F.explode(F.sequence(F.lit(0), F.lit(cfg.trees - 1))).alias("t")).select("t", F.expr(f"substring(sig, t * {width} + 1, {4 * max(cfg.depth(), cfg.shallowest)})").alias("path"), "cid")
    members = written(tries(leaves, cfg))
    full = classes.select("cid", "sig", "size").withColumn("star", F.lit(None).cast("binary"))
    dealt, stars = dealt_blocks(members, cfg), None
    if not members.where(F.col("n") > cfg.block).isEmpty():
        stars, seen = starred(members, classes, docs, cfg, id_col, text_col)
        dealt = dealt_blocks(members.where(F.col("n") <= cfg.block), cfg).unionByName(dealt_stars(members.where(F.col("n") > cfg.block), stars, seen, cfg))
        full = written(full.drop("star").join(stars, "cid", "left"))
    dealt = dealt.select("t", "p", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "cid")

    def survivors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches):
            first, other = likely(g, cfg)
            keep = (first | other).any(1)
            if keep.any():
                yield from g.select([*GROUP, "block", "cid"]).filter(pa.array(keep)).combine_chunks().to_batches()

    by_group = lambda df: df.repartition(*GROUP).sortWithinPartitions(*GROUP)
    asked = written(by_group(dealt.join(full, "cid").select(*GROUP, "block", "cid", "sig", "star")).mapInArrow(survivors, "t int, p long, i int, j int, block int, cid binary"))

    # the whole shingle sets of those classes only, from one row each
    wanted = asked.select("cid").distinct().join(classes, "cid").select(F.col("best.k").alias("k"), "cid")
    sets = shingle_sets(docs, wanted, id_col, text_col).join(full, "cid")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches):
            ok, more = linked(g, cfg)
            some = np.flatnonzero((ok | more).any(1))
            if not len(some):
                continue
            size, cid = g["size"].to_numpy(), g["cid"].to_pylist()
            root = np.arange(len(cid))
            while True:  # labels spread over the group's links; each round also jumps to the label's label
                low = np.minimum(root, np.where(ok | more, root[None, :], len(cid)).min(1))
                low = low[low]
                if (low == root).all():
                    break
                root = low
            links = ok @ size
            a, b = np.nonzero(more)  # pairs that may meet again: they are counted once in the end
            pick = lambda at: pa.array([None if x is None else cid[x] for x in at], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pick([*some, *a]), pa.array(np.concatenate([links[some], size[b]]).astype(np.int64)), pick([*root[some], *root[a]]), pick([*[None] * len(some), *b])],
                ["cid", "links", "root", "other"],
            )

    found = written(by_group(asked.join(sets, "cid").select(*GROUP, "block", "cid", "size", "sig", "star", "shingles")).mapInArrow(verify, "cid binary, links long, root binary, other binary"))
    edges = found.select(F.col("cid").alias("a"), F.col("root").alias("b"))
    counted = found.where("other is null").select("cid", "links").unionByName(found.where("other is not null").dropDuplicates(["cid", "other"]).select("cid", "links"))
    if stars is not None:
        inside = full.where("star is not null")
        total = written(inside.groupBy("star").agg(F.sum("size").alias("total")))
        counted = counted.unionByName(inside.join(total, "star").select("cid", (F.col("total") - F.col("size")).alias("links")))
        edges = edges.unionByName(stars.select(F.col("cid").alias("a"), F.col("star").alias("b")))
    roots = components(edges)
    links = counted.groupBy("cid").agg(F.sum("links").alias("links"))
    about = roots.withColumnRenamed("node", "cid").join(links, "cid", "full")
    table = classes.select("cid", "size", "best").join(about, "cid", "left").select("cid", "size", "best", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root"))
    return rows.select("k", "id", "cid"), table


def copy_groups(docs: DataFrame, cfg: Forest | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, class_id (the least id of its group of near copies), n_links (the other rows
    whose text is equal or similar to its own), text_class (the least id of rows with its very
    shingle set) and class_size (rows of that set).

    A shingle is a run of five words; a text of one to four words has one, all its words. Null texts
    and texts without words are like nothing: class_id is their own id, n_links 0. Repeated rows each
    give a row and count as copies of each other. A null id counts as less than any other.
    """
    cfg = cfg or Forest()
    rows, classes = near_copies(docs, cfg, id_col, text_col)
    group = classes.groupBy("root").agg(F.min(F.struct(F.col("best.id").alias("id"))).alias("least"))
    named = classes.join(group, "root").select("cid", F.col("least.id").alias("class_id"), (F.col("links") + F.col("size") - 1).alias("n_links"), F.col("best.id").alias("text_class"), F.col("size").alias("class_size"))
    alone = F.col("cid").isNull()
    return rows.join(named, "cid", "left").select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("text_class")).alias("text_class"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )


def without_copies(docs: DataFrame, cfg: Forest | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies, the one with the least id. Rows with equal id
    and text count as one; texts without words all stay."""
    cfg = cfg or Forest()
    rows, classes = near_copies(docs, cfg, id_col, text_col)
    own = "planloom row key"  # no column of docs is called so
    best = classes.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.k").alias(own))
    kept = best.unionByName(rows.where("cid is null").select(F.col("k").alias(own)).distinct())
    names = docs.columns
    return docs.withColumn(own, row_key(id_col, text_col)).join(kept, own, "left_semi").dropDuplicates([own]).select(*names)
