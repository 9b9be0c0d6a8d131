"""Language identification: nearest of several TF-IDF n-gram centroids per language."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, mix64, packs, texts_of
from .token_counts import CH_E, CH_L, CH_R, CH_V, LET, STMD, char_classes

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """`sample` bounds the texts per language that clustering reads, and `longest` the bytes of each of
    them; document frequencies come from all texts that may be learned from. A text further from every centroid than its language's
    training texts ever were, but for the share `reject`, is marked as rejected."""

    bits: int = 13
    sizes: tuple[int, ...] = (2, 3)
    centroids: int = 4
    sample: int = 1024
    longest: int = 1 << 18
    rounds: int = 8
    reject: float = 0.005


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # one unit vector a row
    langs: list[str]  # the language of each row
    floor: np.ndarray  # per row's language: the cosine under which a text is rejected


def tf_vectors(texts: list[str], cfg: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts of the lower-cased letters (all else counts as a gap), a row per text;
    and whether the text has a letter at all."""
    dims = 1 << cfg.bits
    low = [t.lower() for t in texts]
    joined = "   ".join(low) + "   "
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = char_classes()[chars]
    letter = np.isin(kinds, (LET, STMD, CH_R, CH_V, CH_E, CH_L))
    c = np.where(letter, chars, np.uint32(32)).astype(np.uint64)
    sizes = np.array([len(t) + 3 for t in low])
    row = np.repeat(np.arange(len(texts)), sizes)
    out = np.zeros((len(texts), dims), np.float32)
    for size in cfg.sizes:
        n = len(c) - size + 1
        h, some = np.full(n, size, np.uint64), np.zeros(n, bool)
        for k in range(size):
            h = h * np.uint64(0x100000001B3) + c[k : k + n]
            some |= letter[k : k + n]
        some &= row[:n] == row[size - 1 :]  # none that begins in the gap after a text and ends in the next one
        at = (mix64(h[some]) & np.uint64(dims - 1)).astype(np.int64) + row[:n][some] * dims
        out += np.bincount(at, minlength=out.size).reshape(out.shape)
    return out, np.bincount(row[letter], minlength=len(texts)) > 0


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(counts) * idf)


def cluster(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; it begins with the first row and, again and again, the row least like any chosen."""
    chosen = x[:1]
    while len(chosen) < min(k, len(x)):
        chosen = np.concatenate([chosen, x[(x @ chosen.T).max(1).argmin()][None]])
    for _ in range(rounds):
        near = (x @ chosen.T).argmax(1)
        chosen = unit(np.stack([x[near == i].mean(0) if (near == i).any() else chosen[i] for i in range(len(chosen))]))
    return chosen


def fit(docs: DataFrame, cfg: Settings, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from the rows where `learn_from` holds and language and text are not null: document
    frequencies in one pass, then the centroids of all languages in another."""
    known = docs.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k"), F.col(text_col).alias("_t"), F.col(lang_col).cast("string").alias("lang")
    )
    dims = 1 << cfg.bits

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims, np.int64), 0
        for b in packs(batches, "_t", rows=256):
            counts, _ = tf_vectors(texts_of(b, "_t"), cfg)
            df += (counts > 0).sum(0)
            n += len(counts)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["at", "n"])

    summed = known.select("_t").mapInArrow(frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(summed["at"].to_pylist(), summed["n"].to_pylist(), strict=True))  # at most 2**bits + 1 rows
    n = found.pop(-1, 0)
    df = np.zeros(dims)
    df[list(found)] = list(found.values())
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 0.1
    if not n:
        return Model(idf, np.zeros((0, dims), np.float32), [], np.zeros(0))
    # of each language the ids whose hashes come first; a rank of at most `sample` is kept by every task alone already
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("k"), "k"))
    short = known.where(F.octet_length("_t") <= cfg.longest)
    chosen = short.select("k", "lang").distinct().withColumn("n", first).where(F.col("n") <= cfg.sample).select("k", "lang")
    picked = short.join(F.broadcast(chosen), ["k", "lang"])  # at most cfg.sample ids a language

    def centroids(part: pa.Table) -> pa.Table:
        part = part.sort_by([("k", "ascending"), ("_t", "ascending")]).combine_chunks()
        x = np.concatenate([tfidf(tf_vectors(texts_of(b, "_t"), cfg)[0], idf) for b in packs(part.to_batches(), "_t", rows=256)])
        c = cluster(x, cfg.centroids, cfg.rounds)
        floor = float(np.quantile((x @ c.T).max(1), cfg.reject))
        return pa.table([pa.array([part["lang"][0].as_py()] * len(c)), pa.array(range(len(c)), pa.int32()), pa.array(list(c.astype(np.float32)), pa.list_(pa.float32())), pa.array([floor] * len(c))], ["lang", "i", "c", "floor"])

    # a few rows a language come to the driver
    found = picked.groupBy("lang").applyInArrow(centroids, "lang string, i int, c array<float>, floor double").toArrow().sort_by([("lang", "ascending"), ("i", "ascending")])
    if not found.num_rows:
        return Model(idf, np.zeros((0, dims), np.float32), [], np.zeros(0))
    return Model(idf, np.array(found["c"].to_pylist(), np.float32), found["lang"].to_pylist(), found["floor"].to_numpy())


def predict(docs: DataFrame, model: Model, cfg: Settings, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred, score (cosine with the nearest centroid, 0 to 1) and rejected.

    A null text, and one without a letter, is 'und' with score 0 and rejected, as is every text if
    the model has learned nothing. Of equally near centroids the first language by name wins.
    A rejected text still names its nearest language in lang_pred. Repeated rows each give a row. A
    kept column with one of the new names gives way to it.
    """
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score", "rejected")]
    (t,) = fresh(keep, "text")
    base = docs.select(*keep, F.col(text_col).alias(t))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = base.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for b in packs(batches, t, rows=256):
            counts, lettered = tf_vectors(texts_of(b, t), cfg)
            if m.langs:
                cos = tfidf(counts, m.idf) @ m.centroids.T
                best = cos.argmax(1)
                score = np.where(lettered, np.clip(cos[np.arange(len(cos)), best], 0, 1), 0.0).astype(np.float64)
                name = [m.langs[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                far = ~lettered | (score < m.floor[best])
            else:
                score, name, far = np.zeros(len(counts)), [UNKNOWN] * len(counts), np.ones(len(counts), bool)
            yield pa.RecordBatch.from_arrays([*(col(b, k) for k in keep), pa.array(name), pa.array(score), pa.array(far)], schema.names)

    return base.mapInArrow(run, schema)
