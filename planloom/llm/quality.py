"""Document quality: hashed word n-gram logistic regression, learned by FTRL-proximal."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, mix64, packs, texts_of, written

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Words that say nothing beyond their form are told by these instead of their own hash.
SAME_AS_LAST, SHOUTED, LOWER, CAPITAL, NUMBER, MARK, MIXED = range(1, 8)
MOST_CACHED = 200_000


@dataclass(frozen=True)
class Ftrl:
    """Settings. `sample` bounds the labelled rows that training reads, and `most_features` their
    features in all (12 bytes each on the driver); all else covers every row."""

    bits: int = 18
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    epochs: int = 4
    sample: int = 8192
    most_features: int = 32_000_000
    threshold: float = 0.7
    scale: float = 8.0


class Features:
    """Hashed unigrams, bigrams and word-form bigrams of texts; a text's features share weight 1."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.known: dict[str, int] = {}

    def code(self, word: str) -> int:
        """32 bits of the word's hash and its form above them."""
        if len(self.known) > MOST_CACHED:
            self.known.clear()
        form = NUMBER if word.isdigit() else MARK if not word[0].isalnum() else LOWER if word.islower() else SHOUTED if len(word) > 1 and word.isupper() else CAPITAL if word.istitle() else MIXED
        out = self.known[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) | form << 32
        return out

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The features of all texts in a row, and where each text's begin (one more entry at the end)."""
        codes, sizes = [], []
        get, code = self.known.get, self.code
        for t in texts:
            words = TOKEN.findall(t)
            sizes.append(len(words))
            codes += [get(w) or code(w) for w in words]
        c = np.array(codes, np.uint64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        before = np.zeros(len(c), np.uint64)
        before[1:] = c[:-1]
        before[begin[:-1][np.diff(begin) > 0]] = 0
        word, form = c & np.uint64(0xFFFFFFFF), c >> np.uint64(32)
        word0, form0 = before & np.uint64(0xFFFFFFFF), before >> np.uint64(32)
        pair = np.where(c == before, np.uint64(SAME_AS_LAST), mix64(word0 * np.uint64(31) + word + np.uint64(1 << 40)))
        shape = mix64((form0 << np.uint64(8)) + form + np.uint64(1 << 41))
        out = np.stack([mix64(word) & self.mask, pair & self.mask, shape & self.mask], 1).ravel()
        return out.astype(np.int64), begin * 3


def score_texts(features: Features, weights: np.ndarray, bias: float, scale: float, texts: list[str]) -> np.ndarray:
    """Probabilities of label 1; a text without words gets that of the bias alone."""
    f, begin = features.of(texts)
    total = np.concatenate([[0.0], np.cumsum(weights.take(f))])
    n = np.diff(begin)
    z = bias + scale * (total[begin[1:]] - total[begin[:-1]]) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cfg: Ftrl) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (feature, value) rows in the given order; returns weights and bias."""
    n, z = np.zeros(1 << cfg.bits), np.zeros(1 << cfg.bits)
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    bias, bias_n = float(np.log(share / (1 - share))), 0.0
    for _ in range(cfg.epochs):
        for (f, x), y in zip(rows, labels, strict=True):
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) <= cfg.l1, 0.0, -(zf - np.sign(zf) * cfg.l1) / ((cfg.beta + np.sqrt(nf)) / cfg.alpha + cfg.l2))
            p = 1 / (1 + np.exp(-np.clip(bias + w @ x, -35, 35)))
            g = (p - y) * x
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / cfg.alpha * w
            n[f] = nf + g * g
            bias_n += (p - y) ** 2
            bias -= 0.1 * (p - y) / (1 + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= cfg.l1, 0.0, -(z - np.sign(z) * cfg.l1) / ((cfg.beta + np.sqrt(n)) / cfg.alpha + cfg.l2))
    return w.astype(np.float32), float(bias)


def fit(docs: DataFrame, labels: DataFrame, cfg: Ftrl, learn_from, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Learns from at most cfg.sample labelled rows for which `learn_from` (a condition on id_col)
    holds: those whose hashed ids come first, in that order, as far as cfg.most_features go. An id
    with several labels counts as 1 if their mean is at least 0.5; null ids and labels teach nothing,
    nor do labels without a document. Without any row, the score is 0.5 everywhere."""
    known = (
        labels.where(learn_from)
        .select(F.col(id_col).alias("k"), F.col(label_col).cast("double").alias("y"))
        .where("k is not null and y is not null")
        .groupBy("k")
        .agg(F.avg("y").alias("y"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(cfg.sample)
    )
    picked = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(known), "k")  # at most cfg.sample ids

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(cfg.bits)
        for b in packs(batches, "t"):
            f, begin = make.of(texts_of(b, "t"))
            every = [np.unique(f[lo:hi], return_counts=True) for lo, hi in zip(begin[:-1], begin[1:], strict=True)]
            values = [(n / max(1, n.sum())).astype(np.float32) for _, n in every]
            yield pa.RecordBatch.from_arrays(
                [col(b, "k").cast(pa.string()), col(b, "y"), pa.array([x[0].astype(np.int32) for x in every], pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                ["k", "y", "f", "x"],
            )

    rows = written(picked.mapInArrow(features, "k string, y double, f array<int>, x array<float>"))
    # how far the features go: over at most cfg.sample short rows (more only where ids are repeated)
    so_far = F.sum(F.size("f")).over(Window.orderBy(F.crc32(F.col("k").cast("binary")), "k").rowsBetween(Window.unboundedPreceding, 0))
    got = rows.join(F.broadcast(rows.select("k", "f").select("k", so_far.alias("n")).groupBy("k").agg(F.max("n").alias("n")).where(F.col("n") <= cfg.most_features).select("k")), "k", "left_semi").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (zlib.crc32(got["k"][i].as_py().encode()), got["k"][i].as_py(), zlib.crc32(got["f"][i].values.to_numpy().tobytes())))
    rows = [(got["f"][i].values.to_numpy(), got["x"][i].values.to_numpy().astype(np.float64) * cfg.scale) for i in order]
    return train_ftrl(rows, (got["y"].to_numpy()[order] >= 0.5).astype(np.float64), cfg)


def quality_scores(docs: DataFrame, weights: np.ndarray, bias: float, cfg: Ftrl, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns `keep` (all if None) with score and predicted (1 if score >= cfg.threshold).

    Every whole text is scored. Null and empty texts score as the bias alone; repeated rows each
    give a row. A column of docs named score or predicted is replaced; `passing` keeps them.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    (t,) = fresh(keep, "text")
    base = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias(t))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = base.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(cfg.bits)
        for b in packs(batches, t):
            p = score_texts(make, shared.value, bias, cfg.scale, texts_of(b, t))
            columns = [col(b, c) for c in keep] + [pa.array(p), pa.array((p >= cfg.threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return base.mapInArrow(run, schema)


def passing(docs: DataFrame, weights: np.ndarray, bias: float, cfg: Ftrl, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of at least cfg.threshold, all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(cfg.bits)
        for b in packs(batches, text_col):
            yield b.filter(pa.array(score_texts(make, shared.value, bias, cfg.scale, texts_of(b, text_col)) >= cfg.threshold))

    return docs.mapInArrow(run, docs.schema)
