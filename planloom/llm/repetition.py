"""Quality rules on repetition, from a suffix array over each text's words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, packs, texts_of
from .suffixes import common_prefixes, refine

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """A text is kept by the method if its repeated substrings of at least `least` words cover at
    most `covered` of its words and the longest has at most `longest` words."""

    least: int = 8
    covered: float = 0.3
    longest: int = 150


def maximal_repeats(lcp: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """By rank in the suffix array: the length of the longest maximal repeat that begins there (0: none
    of `least` symbols); and the lengths of all maximal repeats, one each.

    An interval of ranks whose common prefix is longer than at either border is a repeat that cannot
    grow to the right; it is maximal if its suffixes are not all preceded by one symbol (`before`, by
    rank). Intervals nest; a rank belongs to the innermost and takes the nearest maximal one around it.
    A shorter repeat that could grow to the left lies in the one that it grows to.
    """
    reach = np.zeros(len(before), np.int64)
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])]) if len(before) else np.zeros(0, np.int64)
    found: list[tuple[int, int, int]] = []  # first rank, last rank, length: inner ones first
    open_: list[tuple[int, int]] = []
    waiting: list[int] = []  # ranks that no closed interval holds yet
    inner: dict[int, int] = {}

    def close(first: int, last: int, length: int) -> None:
        while waiting and waiting[-1] >= first:
            inner[waiting.pop()] = len(found)
        found.append((first, last, length))

    at = np.flatnonzero(lcp >= least)
    previous = -1
    for i, length in zip(at.tolist(), lcp[at].tolist(), strict=True):
        if i != previous + 1:
            while open_:
                first, longer = open_.pop()
                close(first, previous, longer)
            waiting[:] = [i - 1]
        first = i - 1
        while open_ and open_[-1][1] > length:
            first, longer = open_.pop()
            close(first, i - 1, longer)
        if not open_ or open_[-1][1] < length:
            open_.append((first, length))
        waiting.append(i)
        previous = i
    while open_:
        first, longer = open_.pop()
        close(first, previous, longer)

    own, around, lengths = [0] * len(found), [], []
    for k in range(len(found) - 1, -1, -1):  # outer ones first
        first, last, length = found[k]
        while around and not (found[around[-1]][0] <= first and last <= found[around[-1]][1]):
            around.pop()
        if changes[last] != changes[first]:
            own[k] = length
            lengths.append(length)
        elif around:
            own[k] = own[around[-1]]
        around.append(k)
    for rank, k in inner.items():
        reach[rank] = own[k]
    return reach, np.array(lengths, np.int64)


def cover(begin: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans begin .. begin + length."""
    edge = np.bincount(begin, minlength=n + 1) - np.bincount(begin + length, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def measure(texts: list[str], limits: Limits) -> dict[str, np.ndarray]:
    """The rule values of each text. One suffix array serves all the texts: a word's symbol includes
    the text that it is in, so no repeat spans or joins two texts."""
    m = len(texts)
    ids: dict[bytes, int] = {}
    symbols, sizes = [], []
    out = {k: np.zeros(m, np.int64) for k in ("word_chars", "n_symbols", "n_dup_lines")}
    for i, t in enumerate(texts):
        words = t.encode("utf-8", "surrogatepass").split()  # bytes split at exactly space and \t..\r
        sizes.append(len(words))
        symbols += [ids.setdefault(w, len(ids)) for w in words]
        out["word_chars"][i] = len(t) - sum(map(t.count, SPACES))
        out["n_symbols"][i] = sum(map(t.count, SYMBOLS))
        if "\n" in t:
            lines = [x for x in t.split("\n") if x.strip(SPACES)]
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    n_words = np.array(sizes, np.int64)
    n = len(symbols)
    text_of = np.repeat(np.arange(m), n_words)
    levels: list = []
    sa, _ = refine(text_of * max(1, len(ids)) + np.array(symbols, np.int64), 1, levels=levels)
    lcp = np.append(common_prefixes(sa, levels), 0)
    longest = np.zeros(n, np.int64)  # at each word: the longest substring from here that is also elsewhere
    longest[sa] = np.maximum(lcp[:-1], lcp[1:])
    per = lambda flags: np.bincount(text_of[flags], minlength=m)
    short = np.flatnonzero(longest >= 3)  # the base rule counts windows, whether or not they are maximal
    out["n_repeat_words"] = per(cover(short, longest[short], n))
    before = -1 - np.arange(n)  # a text's first word is preceded by something of its own
    inside = np.flatnonzero(np.diff(text_of) == 0) + 1
    before[inside] = np.array(symbols, np.int64)[inside - 1]
    by_rank, _ = maximal_repeats(lcp[:-1], before[sa], limits.least)
    long = np.flatnonzero(by_rank)
    out["n_covered"] = per(cover(sa[long], by_rank[long], n))
    out["longest_repeat"] = np.zeros(m, np.int64)
    np.maximum.at(out["longest_repeat"], text_of, longest)
    out["base_failed"] = (n_words < 50) | (100 * out["n_repeat_words"] > 50 * n_words)
    by_method = (out["n_covered"] <= limits.covered * n_words) & (out["longest_repeat"] <= limits.longest)
    out["kept"] = ~out["base_failed"] & by_method
    return {"n_words": n_words} | out


def repetition_rules(docs: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, and n_covered and longest_repeat in words.

    Words are runs of anything but space and \\t..\\r. Null counts as a text without words: all
    numbers 0, base_failed. Repeated rows each give a row; a null id stays null.
    """
    limits = limits or Limits()
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered", "longest_repeat"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in packs(batches, "_t"):
            got = measure(texts_of(b, "_t"), limits)
            yield pa.RecordBatch.from_arrays([col(b, "_k"), *(pa.array(got[x]) for x in names)], [id_col, *names])

    kinds = ", ".join(f"{x} {'boolean' if x in ('base_failed', 'kept') else 'long'}" for x in names)
    return docs.select(F.col(id_col).alias("_k"), F.col(text_col).alias("_t")).mapInArrow(run, f"`{id_col}` {id_type}, {kinds}")
