"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

A text's segmentations are the leaves of a tree that chooses one piece after another. Each node has
the probability mass of the leaves below it (backward sums over the lattice) and a perturbed value:
the largest Gumbel-perturbed log probability of those leaves. The root's value is a Gumbel draw;
the child that holds the largest leaf inherits its parent's value, the others draw Gumbels truncated
to it. Best-first search by these values (A-star whose estimate is exact) meets the leaves in order
of their perturbed log probability, which is sampling without replacement. The k+1st value kappa
gives inclusion scores 1 - exp(-exp(log p - kappa)).

All draws are hashes of the row's key, the number of the sample and the place in the text, so a row
gives the same samples wherever and however often it is computed. The first children of a path are
drawn one by one; all later ones are one lump with their joint mass, drawn apart only if the search
comes to it.

Pieces of a BPE model have ranks, no probabilities; p is taken proportional to 1 / (rank + 2.7). The
pieces of several spaces have no rank and weigh as much as the piece of the last rank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, mix64, packs, texts_of

SPACE = 0x2581
BLOCK = 128
SOME = 1 << 14
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)


class Pieces:
    """The pieces of a model file: ids by hash of any of their beginnings, weights, bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        unranked = [i for i in normal if sp.get_score(i) <= -1e8 and len(sp.id_to_piece(i)) > 1]
        ranked = sorted(set(normal) - set(unranked), key=lambda i: (-sp.get_score(i), i))
        weight = 1 / (np.arange(len(ranked)) + 2.7)
        self.weight = np.full(n + 1, np.nan)
        self.weight[ranked] = np.log(weight / weight.sum())
        self.weight[unranked] = self.weight[ranked[-1]]
        self.by_byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.unknown = float(np.log(weight[-1] / weight.sum())) - 2.0  # of a character without a piece, per byte
        self.raw = [sp.id_to_piece(i).replace(chr(SPACE), " ").encode() for i in range(n)]
        for b, i in enumerate(self.by_byte.tolist()):
            self.raw[i] = bytes([b])
        self.raw_size = np.array([len(r) for r in self.raw])
        self.raw_begin = np.cumsum(self.raw_size) - self.raw_size
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_arrow = pa.array(self.raw, pa.large_binary())
        begins: dict[int, int] = {}
        for i in normal:
            h = 0
            for c in sp.id_to_piece(i):
                h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
                begins.setdefault(h, -1)
            begins[h] = i
        self.most = max(len(sp.id_to_piece(i)) for i in normal)
        self.grows = np.zeros(n + 1, bool)  # whether longer pieces begin with this one; the last entry is for -1, a mere beginning
        self.grows[-1] = True
        for i in normal:
            h = 0
            for c in sp.id_to_piece(i)[:-1]:
                h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
                if begins[h] >= 0:
                    self.grows[begins[h]] = True
        keys = np.array(list(begins), np.uint64)
        ids = np.array(list(begins.values()), np.int32)
        self.bits = np.uint64(64 - 19)
        self.key, self.id = np.zeros(1 << 19, np.uint64), np.full(1 << 19, -2, np.int32)
        self.probes = 0
        rest, k = np.arange(len(keys)), 0
        while len(rest):  # open addressing: whoever is first at a free slot stays, the others move on
            at = ((keys[rest] * ODD >> self.bits).astype(np.int64) + k) & (len(self.key) - 1)
            free = self.id[at] == -2
            _, first = np.unique(at, return_index=True)
            taken = np.zeros(len(rest), bool)
            taken[first] = free[first]
            self.key[at[taken]], self.id[at[taken]] = keys[rest[taken]], ids[rest[taken]]
            rest, k = rest[~taken], k + 1
        self.probes = k

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id, -1 for a mere beginning of pieces, -2 for neither."""
        at = (h * ODD >> self.bits).astype(np.int64)
        ids = self.id.take(at)
        hit = self.key.take(at) == h
        out = np.where(hit, ids, np.int32(-2))
        rest = np.flatnonzero(~hit & (ids != -2))
        for k in range(1, self.probes):
            if not len(rest):
                break
            a = (at[rest] + k) & (len(self.key) - 1)
            ids, hit = self.id.take(a), self.key.take(a) == h[rest]
            out[rest[hit]] = ids[hit]
            rest = rest[~hit & (ids != -2)]
        return out


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """The lattice of some words laid end to end. Words that end alike share the places of their common
    ending, as all that is known of a place depends on what follows alone. Places are numbered by how
    many characters there are to the word's end, most first, so what the backward sums need at once
    lies together; `first` is each word's first place. Edges of a place are eo[place]:eo[place + 1],
    short ones first."""

    def __init__(self, model: Pieces, chars: np.ndarray, ends: np.ndarray):
        sizes = np.diff(np.concatenate([[0], ends]))
        left = np.repeat(ends, sizes) - np.arange(len(chars))
        place, some, on = endings(chars, left, ends)
        self.first = place[ends - sizes]
        self.chars = chars[some]
        n = len(some)
        counts = np.bincount(left[some])[:0:-1]  # places with so many characters to go, from the most
        begins = np.cumsum(counts) - counts
        code = self.chars.astype(np.uint64) + np.uint64(1)
        at = last = np.arange(n)
        h = code
        levels = []
        found = np.zeros(n, np.int64)  # edges of each place so far
        for _ in range(model.most):
            ids = model.find(h)
            after = on.take(last)
            ok = np.flatnonzero(ids >= 0) if levels else slice(None)  # a character without a piece is an edge too
            mine = at[ok]
            nth = found[mine]
            levels.append((mine, np.maximum(ids[ok], -1), after[ok], nth))
            found[mine] = nth + 1
            more = np.flatnonzero((ids != -2) & model.grows.take(ids) & (after < n))
            at, last = at[more], after[more]
            if not len(at):
                break
            h = h[more] * BASE + code[last]
        self.eo = np.concatenate([[0], np.cumsum(found)])
        self.place = np.repeat(np.arange(n, dtype=np.int32), found)
        self.piece, self.next = np.empty(self.eo[-1], np.int32), np.empty(self.eo[-1], np.int64)
        for mine, ids, after, nth in levels:
            to = self.eo.take(mine) + nth
            self.piece[to], self.next[to] = ids, after
        self.next[self.next == n] = -1
        weight = model.weight.take(self.piece)
        bare = np.flatnonzero(self.piece < 0)
        weight[bare] = model.unknown * utf8_size(self.chars[self.place[bare]])
        beta = np.zeros(n + 1)  # the last entry is the word's end
        #: log probability of each edge, given that its place is reached
        self.log_p = np.empty(len(weight))
        for lo, hi in zip(begins[::-1].tolist(), (begins + counts)[::-1].tolist(), strict=True):
            a, b = int(self.eo[lo]), int(self.eo[hi])
            v = weight[a:b] + beta.take(self.next[a:b])
            first, many = self.eo[lo:hi] - a, found[lo:hi]
            top = np.maximum.reduceat(v, first)
            beta[lo:hi] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, many)), first))
            np.subtract(v, np.repeat(beta[lo:hi], many), out=self.log_p[a:b])
        np.minimum(self.log_p, 0.0, out=self.log_p)
        self.upto = np.exp(self.log_p)
        at, k = np.flatnonzero(found > 1), 1
        while len(at):  # place by place, so a word's numbers don't depend on its neighbours
            to = self.eo.take(at) + k
            self.upto[to] += self.upto.take(to - 1)
            k += 1
            at = at[found.take(at) > k]
        self.upto[self.eo[1:] - 1] = 2.0  # the last edge takes what rounding leaves


def endings(chars: np.ndarray, left: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers for the endings of words that begin at each character, equal ones alike and long ones
    first; of each number one such character, and the number that follows (at the end: how many there are)."""
    before = np.concatenate([[0], ends])
    for salt in range(1 << 10):
        h = mix64(chars.astype(np.uint64) + (left.astype(np.uint64) << np.uint64(32)) + np.uint64(salt << 21))
        h = np.append(np.cumsum(h[::-1])[::-1], np.uint64(0))
        h = h[:-1] - np.repeat(h[ends], np.diff(before))
        order = np.argsort(h)
        h = h[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        some = order[new]
        # 16-bit keys sort by radix; there are longer words only in odd texts
        far = left.max() - left[some]
        by_left = np.argsort(far.astype(np.uint16) if far.max() < 1 << 16 else far, kind="stable")
        number = np.empty(len(some), np.int64)
        number[by_left] = np.arange(len(some))
        place = np.empty(len(chars), np.int64)
        place[order] = number[np.cumsum(new) - 1]
        some = some[by_left]
        after = np.append(place[1:], 0)
        after[ends - 1] = len(some)
        # equal numbers are equal endings, as their first characters and what follows are equal
        if (chars[some][place] == chars).all() and (after[some][place] == after).all():
            return place, some, after[some]
    raise AssertionError("hashes of word endings collide whatever the salt")


def utf8_size(chars: np.ndarray) -> np.ndarray:
    return 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)


def uniform(key: np.ndarray) -> np.ndarray:
    return ((mix64(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gumbel_below(phi: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel draws at location phi, each truncated to be under top."""
    with np.errstate(over="ignore", divide="ignore"):
        return phi - np.logaddexp(phi - top, np.log(-np.log(u)))


def walk(lat: Lattice, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples each word to its end from the given places (-1: at its end already): the number of
    edges of each word, and all edges in order. Goes by some words at a time, equal and like ones
    together, so what they read stays in cache."""
    count = np.zeros(len(start), np.int64)
    steps = []
    order = np.argsort(start)
    order = order[np.searchsorted(start, 0, sorter=order) :]
    for lo in range(0, len(order), SOME):
        who = order[lo : lo + SOME]
        at, keys, k = start.take(who), key.take(who), 0
        while len(who):
            u = uniform(keys + np.uint64(k * int(ODD) & 2**64 - 1))
            e = lat.eo.take(at)
            rest = np.flatnonzero(u > lat.upto.take(e))
            later, u = e.take(rest), u.take(rest)
            while len(rest):
                later += 1
                e[rest] = later
                on = np.flatnonzero(u > lat.upto.take(later))
                rest, later, u = rest.take(on), later.take(on), u.take(on)
            steps.append((k, who, e))
            count[who] = k = k + 1
            at = lat.next.take(e)
            on = np.flatnonzero(at >= 0)
            who, at, keys = who.take(on), at.take(on), keys.take(on)
    begin = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for k, who, e in steps:
        out[begin.take(who) + k] = e
    return count, out


Nodes = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # value, phi, edge number in the path, edge (-1: a lump)


def expand(lat: Lattice, items: list[tuple]) -> list[list[Nodes]]:
    """The siblings along each path[first:first + BLOCK], and those beyond as one lump, under `top`.

    An item is (path, log probability of path[:first], first, top, key, log probability of the path).
    Each row of a matrix is one path, so its sums don't depend on what else is expanded with it."""
    n = len(items)
    part = np.full((n, BLOCK), -1)
    for r, (path, _, first, *_) in enumerate(items):
        cut = path[first : first + BLOCK]
        part[r, : len(cut)] = cut
    before, first, top, keys, leaf = (np.array([x[k] for x in items], kind) for k, kind in ((1, float), (2, np.int64), (3, float), (4, np.uint64), (5, float)))
    real = part >= 0
    step = np.where(real, lat.log_p[part], 0.0)
    lead = np.cumsum(np.concatenate([before[:, None], step], 1), 1)
    row, nth = np.nonzero(real)
    taken = part[row, nth]
    p = lat.place[taken]
    sizes = lat.eo[p + 1] - lat.eo[p]
    edge = np.repeat(lat.eo[p] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    of = np.repeat(np.arange(len(p)), sizes)
    other = edge != taken[of]
    edge, of = edge[other], of[other]
    row, nth = row[of], nth[of]
    phi = lead[row, nth] + lat.log_p[edge]
    at = first[row] + nth
    more = np.array([len(x[0]) > x[2] + BLOCK for x in items]) & (leaf < lead[:, -1])
    lump = np.flatnonzero(more)
    with np.errstate(divide="ignore"):
        lump_phi = lead[lump, -1] + np.log(-np.expm1(leaf[lump] - lead[lump, -1]))
    row, phi = np.concatenate([row, lump]), np.concatenate([phi, lump_phi])
    at, edge = np.concatenate([at, first[lump] + BLOCK]), np.concatenate([edge, np.full(len(lump), -1)])
    value = gumbel_below(phi, top[row], uniform(node_keys(lat, keys[row], at, edge)))
    cut = np.searchsorted(row[: len(row) - len(lump)], np.arange(n + 1))
    out: list[list[Nodes]] = [[(value[a:b], phi[a:b], at[a:b], edge[a:b])] if b > a else [] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    for k, r in enumerate(lump.tolist(), len(row) - len(lump)):
        out[r].append((value[k : k + 1], phi[k : k + 1], at[k : k + 1], edge[k : k + 1]))
    return out


def node_keys(lat: Lattice, keys, at: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Keys of the draws of nodes: by path, place in the path and rank among the place's edges."""
    rank = np.where(edge >= 0, edge - lat.eo[lat.place[edge]], -1)
    return mix64(keys + at.astype(np.uint64) * ODD) + rank.astype(np.uint64) * BASE


def opened(lat: Lattice, item: tuple) -> list[Nodes]:
    """The nodes of a lump whose value is `top`: one of them, by its mass, has this very value."""
    nodes = expand(lat, [item])[0]
    if nodes:
        phi = np.concatenate([x[1] for x in nodes])
        edge, at = (np.concatenate([x[k] for x in nodes]) for k in (3, 2))
        u = uniform(node_keys(lat, np.uint64(item[4]) + BASE, at, edge))
        best = int(np.argmax(phi - np.log(-np.log(u))))
        for value, *_ in nodes:
            if best < len(value):
                value[best] = item[3]
                break
            best -= len(value)
    return nodes


def word_hashes(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each word; some words at a time, so arrays stay in cache."""
    out = []
    for lo in range(0, len(start), SOME // 4):
        a, b = start[lo : lo + SOME // 4], end[lo : lo + SOME // 4]
        within = np.arange(a[0], b[-1]) - np.repeat(a, b - a)
        out.append(np.add.reduceat(mix64(chars[a[0] : b[-1]].astype(np.uint64) + (within.astype(np.uint64) << np.uint64(32))), a - a[0]))
    return np.concatenate(out)


def sample_pack(model: Pieces, texts: list[str], keys: np.ndarray, k: int):
    """Of each text up to k samples (edges, log probability, perturbed value) and kappa; and the lattice."""
    full = [(" " + t) if t else "" for t in texts]
    chars = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.where(chars == 0x20, np.uint32(SPACE), chars)
    sizes = np.array([len(t) for t in full])
    text_end = np.cumsum(sizes)
    # a word is a run of spaces and what follows it, as pieces may span several spaces
    opens = chars == SPACE
    opens[1:] &= chars[:-1] != SPACE
    opens[(text_end - sizes)[sizes > 0]] = True
    start = np.flatnonzero(opens)
    if not len(start):
        return None, [([(np.zeros(0, np.int64), 0.0, 0.0)], -np.inf) for _ in texts]
    end = np.append(start[1:], len(chars))
    hashes = word_hashes(chars, start, end)
    order = np.argsort(hashes)
    new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
    first, word = order[new], np.empty(len(order), np.int64)
    word[order] = np.cumsum(new) - 1
    length = (end - start)[first]
    ends = np.cumsum(length)
    where = np.repeat(start[first] - ends + length, length) + np.arange(ends[-1])
    lat = Lattice(model, chars[where], ends)
    begin = lat.first[word]  # of each occurrence: its word's first place in the lattice
    text_of = np.searchsorted(text_end, start, "right")
    words_of = np.searchsorted(text_of, np.arange(len(texts) + 1))
    nth = np.arange(len(start)) - words_of[text_of]
    draw = lambda s: mix64(keys[text_of] + np.uint64((s + 1) * int(BASE))) + nth.astype(np.uint64) * ODD
    count, edges = walk(lat, begin, draw(0))
    cuts = np.concatenate([[0], np.cumsum(count)])[words_of]
    root = -np.log(-np.log(uniform(keys + np.uint64(77))))
    done = [[(edges[lo:hi], float(lat.log_p[edges[lo:hi]].sum()), float(r))] for lo, hi, r in zip(cuts[:-1].tolist(), cuts[1:].tolist(), root.tolist(), strict=True)]
    queue: list[list] = [[] for _ in texts]
    kappa = np.full(len(texts), -np.inf)
    alive = [i for i in range(len(texts)) if len(done[i][0][0])]
    fresh = dict.fromkeys(alive, (0, 0.0, 0))  # text: (path to expand, log p before, from its edge)
    key_of = [int(x) for x in keys]
    for s in range(1, k + 1):
        now = [i for i in alive if i in fresh]
        items = []
        for i in now:
            path, before, at = fresh[i]
            edges_i, log_p, top = done[i][path]
            items.append((edges_i, before, at, top, key_of[i] ^ (s << 40), log_p))
        for i, nodes in zip(now, expand(lat, items) if items else [], strict=True):
            queue[i] += [(*x, fresh[i][0]) for x in nodes]
        pick = {}
        for i in alive:
            q = queue[i]
            while q:
                value, phi, at, edge, path = max(q, key=lambda x: x[0].max())
                b = int(value.argmax())
                v, e, a = float(value[b]), int(edge[b]), int(at[b])
                if v == -np.inf:
                    break
                value[b] = -np.inf
                if e >= 0:
                    pick[i] = (v, float(phi[b]), path, a, e)
                    break
                edges_i, log_p, _ = done[i][path]
                q += [(*x, path) for x in opened(lat, (edges_i, float(lat.log_p[edges_i[:a]].sum()), a, v, (key_of[i] ^ (s << 40)) + a & 2**64 - 1, log_p))]
        for i, (v, *_) in pick.items():
            kappa[i] = v
        for i in alive:
            if i not in pick:
                kappa[i] = -np.inf
        if s == k:
            break
        alive = list(pick)
        if not alive:
            break
        # the rest of each picked text after the branching edge, sampled anew for all texts together
        spans, starts, draws = [], [], []
        again = draw(s)
        for i in alive:
            v, phi, path, a, e = pick[i]
            used = done[i][path][0][:a]
            w = words_of[i] + int((lat.next[used] < 0).sum())  # the word that the branching edge lies in
            lo, hi = int(w), int(words_of[i + 1])
            st = begin[lo:hi].copy()
            st[0] = lat.next[e]
            starts.append(st)
            draws.append(again[lo:hi])
            spans.append(hi - lo)
        count, edges = walk(lat, np.concatenate(starts), np.concatenate(draws))
        cuts = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(spans)])]
        fresh = {}
        for i, lo, hi in zip(alive, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            v, phi, path, a, e = pick[i]
            tail = edges[lo:hi]
            done[i].append((np.concatenate([done[i][path][0][:a], [e], tail]), phi + float(lat.log_p[tail].sum()), v))
            fresh[i] = (len(done[i]) - 1, phi, a + 1)
    return lat, list(zip(done, kappa.tolist(), strict=True))


def ids_of_all(model: Pieces, lat: Lattice, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of paths end to end, and where each path's end; a character without a piece becomes its bytes' pieces."""
    edges = np.concatenate(paths)
    ends = np.cumsum([len(x) for x in paths])
    ids = lat.piece.take(edges)
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids, ends
    c = lat.chars[lat.place[edges[bare]]].astype(np.int64)
    size = utf8_size(c)
    times = np.ones(len(ids), np.int64)
    times[bare] = size
    end = np.cumsum(times)
    ids = np.repeat(ids, times)
    at = end[bare] - size
    for k in range(4):  # the k-th byte: its first one has a mark of the size, the others six bits each
        on = size > k
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size[on]] if k == 0 else 0x80
        bits = c[on] >> (6 * (size[on] - 1 - k))
        ids[at[on] + k] = model.by_byte[lead | (bits if k == 0 else bits & 0x3F)]
    return ids, np.concatenate([[0], end])[ends]


def ids_of(model: Pieces, lat: Lattice, edges: np.ndarray, text: str) -> np.ndarray:
    """Piece ids of a path of the text."""
    return ids_of_all(model, lat, [edges])[0]


def decode_ids(model: Pieces, ids: Iterable[int]) -> str:
    """The text of piece ids: pieces joined, bytes put together, the leading space taken away."""
    raw = model.raw
    out = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
    return out[1:] if out.startswith(" ") else out


def decodes_to(model: Pieces, ids: np.ndarray, text: bytes) -> bool:
    """Whether decode_ids gives the text."""
    return decode_to(model, ids, np.array([len(ids)]), [text])[0]


def decode_to(model: Pieces, ids: np.ndarray, ends: np.ndarray, texts: list[bytes]) -> list[bool]:
    """For ids that end at `ends`, whether decode_ids gives the texts; the pieces' bytes are gathered at once."""
    joined = model.raw_arrow.take(pa.array(ids))
    at = np.frombuffer(joined.buffers()[1], np.int64)[np.concatenate([[0], ends])].tolist()
    raw = joined.buffers()[2].to_pybytes() if at[-1] else b""
    return [b - a == len(t) + (b > a) and raw[a + 1 : b] == t for a, b, t in zip(at[:-1], at[1:], texts, strict=True)]


def text_keys(ids: list[str | None], seed: int) -> np.ndarray:
    """64 bits of each row key (null has its own)."""
    raw = [hashlib.blake2b(b"\0" if x is None else b"\1" + x.encode(), digest_size=8, salt=seed.to_bytes(8, "little")).digest() for x in ids]
    return np.frombuffer(b"".join(raw), np.uint64)


def sampled_segmentations(
    docs: DataFrame, model_path: str, k: int = 3, seed: int = 0, with_ids: bool = True, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row, `keep` (id_col alone if None) and arrays with an entry per sample, in order of the
    draw: n_pieces, log_prob, perturbed, inclusion, ids_sha256 (of the ids as little-endian int32)
    and, with_ids, the ids; and round_trip, whether every sample decodes to the text again.

    A kept column with one of these names gives way to it. Samples are distinct; there are fewer than k only if the text has fewer segmentations, and then
    each inclusion score is 1. Null and empty texts have one sample, the empty one. Repeated rows
    (equal keys) draw equal samples. Text is taken as the model's identity normaliser takes it, with
    the space before it; a literal U+2581 reads as a space.
    """
    made = ("n_pieces", "log_prob", "perturbed", "inclusion", "ids_sha256", "round_trip", "ids")
    keep = [id_col] if keep is None else [c for c in keep if c.lower() not in made]
    key, text = fresh(keep, "key", "text")
    base = docs.select(*[F.col(c) for c in keep], F.col(id_col).cast("string").alias(key), F.col(text_col).alias(text))
    extra = [("n_pieces", "array<int>"), ("log_prob", "array<double>"), ("perturbed", "array<double>"), ("inclusion", "array<double>"), ("ids_sha256", "array<string>"), ("round_trip", "boolean")]
    extra += [("ids", "array<array<int>>")] if with_ids else []
    schema = docs.select(*keep, *[F.lit(None).cast(t).alias(n) for n, t in extra]).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for b in packs(batches, text):
            texts = texts_of(b, text)
            lat, found = sample_pack(model, texts, text_keys(col(b, key).to_pylist(), seed), k)
            samples = [s for of, _ in found for s in of]
            many = np.array([len(of) for of, _ in found])
            ids, ends = ids_of_all(model, lat, [s[0] for s in samples]) if lat else (np.zeros(0, np.int32), np.zeros(len(samples), np.int64))
            ids = ids.astype("<i4", copy=False)
            cuts = np.concatenate([[0], ends])
            plain = [t.replace(chr(SPACE), " ").encode("utf-8", "surrogatepass") for t in texts]
            same = decode_to(model, ids, ends, [plain[i] for i in np.repeat(np.arange(len(texts)), many).tolist()])
            log_p = np.array([s[1] for s in samples])
            with np.errstate(over="ignore"):  # without a next value kappa is -inf, the score 1
                inclusion = -np.expm1(-np.exp(log_p - np.repeat([kappa for _, kappa in found], many)))
            row = np.concatenate([[0], np.cumsum(many)])
            got = {
                "n_pieces": np.diff(cuts),
                "log_prob": log_p,
                "perturbed": np.array([s[2] for s in samples]),
                "inclusion": inclusion,
                "ids_sha256": [hashlib.sha256(ids[lo:hi]).hexdigest() for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)],
            }
            lists = {n: pa.array(x, schema_type(dict(extra)[n]).value_type) for n, x in got.items()}
            if with_ids:
                lists["ids"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
            made_here = {n: pa.ListArray.from_arrays(pa.array(row, pa.int32()), x) for n, x in lists.items()}
            made_here["round_trip"] = pa.array(np.logical_and.reduceat(same, row[:-1]))
            yield pa.RecordBatch.from_arrays([*(col(b, c) for c in keep), *(made_here[n] for n, _ in extra)], [*keep, *(n for n, _ in extra)])

    return base.mapInArrow(run, schema)


def schema_type(name: str) -> pa.DataType:
    inner = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.list_(schema_type(name[6:-1])) if name.startswith("array<") else inner[name]


def decoded(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """df with out_col: the text of an array of piece ids. A null array gives null."""
    names = [c for c in df.columns if c != out_col]
    base = df.select(*names)
    schema = base.select(*names, F.lit("").alias(out_col)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for b in batches:
            texts = [None if x is None else decode_ids(model, x) for x in col(b, ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], schema.names)

    return base.mapInArrow(run, schema)
