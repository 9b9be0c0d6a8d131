"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer file.

Two deterministic machines replace the tokenizer:

* The splitter reads character classes and marks where a pre-token starts. It has 13 states. A pack
  of texts is cut into equal chunks; every chunk is run from all states at once, which gives its
  state map; the maps are composed by a parallel prefix scan, which gives each chunk's true entry
  state; a second run then emits the marks.
* The counter reads a pre-token's bytes. A state holds what the encoding of the bytes read so far
  can still change: for each suffix that may grow into a longer token, the last token before that
  suffix and the token count there relative to now. Each transition carries the change of the count,
  so the sum along a pre-token is its number of tokens. States and transitions are compiled when
  first met and kept in a dense table; all pre-tokens of a pack walk the table in lockstep.

The counter rests on a property of BPE: t1 t2 is a valid neighbour pair exactly if encoding their
concatenation gives back t1 t2, and the encoding of a prefix ends in the one token that is valid
after the encoding of what precedes it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bytes_of, col, packs

SP, WS, NUM, LET, STMD, CH_R, CH_V, CH_E, CH_L, OTHER, APOS, RESET = range(12)
BOS, L, N, O, A, AR, AV, AL, CLOSED, S1, T1, S2, T2 = range(13)  # noqa: E741
#: Output bits of the splitter: a pre-token starts at this character, or at the one before.
HERE, BEFORE = 1, 2
SEPARATOR = "\n"


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The splitter's class of every code point."""
    every = "".join(map(chr, range(0xD800))) + "\x00" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, k in ((r"\p{L}+", LET), (r"\p{N}+", NUM), (r"\p{White_Space}+", WS)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = k
    out[0x20] = SP
    for chars, k in (("stmd", STMD), ("r", CH_R), ("v", CH_V), ("e", CH_E), ("l", CH_L), ("'", APOS)):
        out[[ord(c) for c in chars]] = k
    return out


@lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output bits, by state * 12 + class."""
    step, out = np.zeros((13, 12), np.uint8), np.zeros((13, 12), np.uint8)
    letters = (LET, STMD, CH_R, CH_V, CH_E, CH_L)
    for s in range(13):
        space = s in (S1, T1, S2, T2)
        held = s in (AR, AV, AL)  # an apostrophe and r, v or l: a contraction if the next letter fits
        as_prefix = s in (S1, S2)  # a space that joins the pre-token after it
        before = BEFORE if s in (S2, T2) or held else 0
        for c in range(12):
            if c == RESET:
                step[s, c], out[s, c] = BOS, BEFORE if held else 0
            elif c in (SP, WS):
                step[s, c] = (S2 if c == SP else T2) if space else (S1 if c == SP else T1)
                out[s, c] = 0 if space else HERE | (BEFORE if held else 0)
            elif (s == AR and c == CH_E) or (s == AV and c == CH_E) or (s == AL and c == CH_L):
                step[s, c] = CLOSED
            elif s == A and c in (STMD, CH_R, CH_V, CH_L):
                step[s, c] = {STMD: CLOSED, CH_R: AR, CH_V: AV, CH_L: AL}[c]
            else:
                kind = L if c in letters else N if c == NUM else O
                same = (kind == L and (s == L or held)) or (kind == N and s == N) or (kind == O and s in (O, A))
                step[s, c] = A if c == APOS and not same and not as_prefix else kind
                out[s, c] = before | (0 if same or as_prefix else HERE)
    return step.ravel(), out.ravel()


def marks(classes: np.ndarray, width: int = 256) -> np.ndarray:
    """Whether a pre-token starts at each position of a class sequence (which starts in BOS)."""
    step, out = splitter()
    n = len(classes)
    rows = -(-n // width)
    padded = np.full(rows * width, RESET, np.uint8)
    padded[:n] = classes
    lanes = np.ascontiguousarray(padded.reshape(rows, width).T).astype(np.intp)
    maps = np.repeat(np.arange(13, dtype=np.uint8)[:, None], rows, 1)
    for column in lanes:
        maps = step.take(maps * np.intp(12) + column)
    gap = 1  # inclusive scan: afterwards maps[:, i] is chunks 0..i composed
    while gap < rows:
        later = maps[:, gap:]
        maps = np.concatenate([maps[:, :gap], np.take_along_axis(later, maps[:, :-gap].astype(np.intp), 0)], 1)
        gap *= 2
    state = np.concatenate([[BOS], maps[BOS, :-1]]).astype(np.uint8)
    bits = np.zeros((width, rows), np.uint8)
    for k, column in enumerate(lanes):
        at = state * np.intp(12) + column
        bits[k] = out.take(at)
        state = step.take(at)
    bits = bits.T.ravel()
    found = (bits & HERE).astype(bool)
    found[:-1] |= (bits[1:] & BEFORE).astype(bool)
    found = found[:n]
    if n and n == rows * width and state[-1] in (AR, AV, AL):
        found[n - 1] = True
    return found


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes: visible Latin-1
    characters stand for themselves, the others for 256, 257, ... in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    """The counting transducer of one tokenizer file, compiled on demand."""

    MOST_STATES = 300_000  #: beyond it (about 150 MB) what is compiled is dropped between packs and grows anew

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"] if t.get("special")]
        special = set(self.special)
        self.tokens = {raw(s) for s in spec["model"]["vocab"] if s not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.split = {a + b: (a, b) for a, b in reversed(self.ranks)}
        self.longer: dict[bytes, list[bytes]] = {}
        for t in self.tokens:
            for k in range(1, len(t)):
                self.longer.setdefault(t[:k], []).append(t)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.opens: dict[tuple[bytes, bytes], bool] = {}
        self.spines: dict[tuple[bytes, bool], list[tuple[bytes, int]]] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((b"", None, 0),)]
        self.ids = {self.states[0]: 0}
        self.filled = 0
        self.slots(1 << 16)

    def slots(self, n: int) -> None:
        """The open-addressed table of transitions: keys are state * 256 + byte, cells hold next
        state * 128 + count change + 64."""
        self.keys, self.cells = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.mask = n - 1

    def slot(self, key: int) -> int:
        at = (key * 0x9E3779B1 >> 12) & self.mask
        while self.keys[at] not in (-1, key):
            at = (at + 1) & self.mask
        return at

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The cells of the keys; -1 where no transition is compiled."""
        at = (keys * 0x9E3779B1 >> 12) & self.mask
        there, got = self.keys.take(at), self.cells.take(at)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            there = self.keys.take(at[rest])
            got[rest] = self.cells.take(at[rest])
            rest = rest[(there != keys[rest]) & (there >= 0)]
        return got

    def spine(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """The parts of a token that come to lie at its right (or left) end while it is merged, the
        whole first, each with the rank of the merge that ends it."""
        known = self.spines.get((token, right))
        if known is None:
            ends, known = 1 << 30, []
            while True:
                known.append((token, ends))
                if token not in self.split:
                    break
                ends, token = self.ranks[self.split[token]], self.split[token][right]
            self.spines[known[0][0], right] = known
        return known

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether encoding a + b gives a, b: no merge across the border comes up before one of its
        two sides is merged away. Of equal ranks the leftmost goes first."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            ranks = self.ranks
            known = self.pairs[a, b] = not any(
                rank < end_x and rank <= end_y
                for x, end_x in self.spine(a, True)
                for y, end_y in self.spine(b, False)
                if (rank := ranks.get((x, y))) is not None
            )
        return known

    def open(self, grown: bytes, last: bytes | None) -> bool:
        """Whether some token that continues `grown` can follow `last`. Only such a suffix is kept
        in a state; where too many tokens continue it to look at, it is kept unseen."""
        longer = self.longer.get(grown)
        if longer is None:
            return False
        if last is None or len(longer) > 64:
            return True
        known = self.opens.get((grown, last))
        if known is None:
            if len(self.opens) > 500_000:
                self.opens.clear()
            known = self.opens[grown, last] = any(self.fits(last, t) for t in longer)
        return known

    def compile(self, at: int) -> None:
        """Adds the transition of state * 256 + byte."""
        state, byte = self.states[at >> 8], bytes([at & 255])
        for grown, last, count in state:
            token = grown + byte
            if token in self.tokens and (last is None or self.fits(last, token)):
                break
        change = count + 1
        new = tuple((g + byte, last, c - change) for g, last, c in state if self.open(g + byte, last)) + ((b"", token, 0),)
        k = self.ids.setdefault(new, len(self.states))
        if k == len(self.states):
            self.states.append(new)
        if 2 * self.filled > self.mask:
            keys, cells = self.keys[self.keys >= 0], self.cells[self.keys >= 0]
            self.slots(4 * (self.mask + 1))
            for key, cell in zip(keys.tolist(), cells.tolist(), strict=True):
                i = self.slot(key)
                self.keys[i], self.cells[i] = key, cell
        i = self.slot(at)
        self.keys[i], self.cells[i] = at, k * 128 + change + 64
        self.filled += 1

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of tokens of each pre-token data[start:end]."""
        if len(self.states) > self.MOST_STATES:
            self.reset()
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        at, size = starts[order], size[order]
        alive = len(at) - np.cumsum(np.bincount(size))
        total, state = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k in range(int(size[0]) if len(size) else 0):
            n = int(alive[k])
            cell = (state[:n] << 8) + data[at[:n] + k]
            got = self.find(cell)
            if got.min() < 0:
                for x in np.unique(cell[got < 0]).tolist():
                    self.compile(x)
                got = self.find(cell)
            total[:n] += (got & 127) - 64
            state[:n] = got >> 7
        out = np.empty(len(at), np.int64)
        out[order] = total
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_pack(machine: Counter, column: pa.Array) -> np.ndarray:
    """Tokens of each text of a string column."""
    off, data = bytes_of(column)
    if not len(data):
        return np.zeros(len(off) - 1, np.int64)
    # one separator byte after each text, so neighbours never touch
    n = len(off) - 1
    shift = np.arange(n)
    joined = np.full(len(data) + n, ord(SEPARATOR), np.uint8)
    joined[np.arange(len(data)) + np.repeat(shift, np.diff(off))] = data
    cuts = off[1:] + shift  # places of the separators
    raw = joined.tobytes()
    lead = np.flatnonzero((joined & 0xC0) != 0x80)  # byte at which each character starts
    chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    classes = char_classes()[chars]
    tokens = np.zeros(n, np.int64)
    closed = cuts
    if machine.special:
        pattern = regex.compile("|".join(regex.escape(s) for s in sorted(machine.special, key=len, reverse=True)).encode())
        for m in pattern.finditer(raw):
            lo, hi = np.searchsorted(lead, [m.start(), m.end()])
            classes[lo:hi] = RESET
            tokens[np.searchsorted(cuts, m.start())] += 1
            closed = np.append(closed, m.start())
    classes[np.searchsorted(lead, cuts)] = RESET
    starts = lead[marks(classes)]
    edges = np.sort(np.concatenate([starts, closed]))
    ends = edges[np.searchsorted(edges, starts, "right")]
    per = machine.counts(joined, starts, ends)
    tokens += np.bincount(np.searchsorted(cuts, starts, "right"), weights=per, minlength=n).astype(np.int64)[:n]
    return tokens


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_bytes, n_tokens and over_limit (n_tokens > limit).

    Counts equal the tokenizer library's, without begin or end tokens; strings of special tokens
    inside a text count as one token, as the library does by default. Null and empty texts have 0
    bytes and 0 tokens. Repeated rows each give a row; a null id stays null; other columns are not
    read. The file is read once in each Python worker, so it must be at the same path on each node.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(tokenizer_path)
        for b in packs(batches, "_t"):
            off, _ = bytes_of(col(b, "_t"))
            n = count_pack(machine, col(b, "_t"))
            yield pa.RecordBatch.from_arrays([col(b, "_k"), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(docs[id_col].alias("_k"), docs[text_col].alias("_t"))
    return picked.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
