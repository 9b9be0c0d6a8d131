"""Operators across documents, against brute force."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planloom.llm import forest, repeats, warc
from planloom.llm.components import components


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- connected components --------------------------------------------------------------------


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {x: find(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- near copies -----------------------------------------------------------------------------


def shingle_set(t):
    w = (t or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_groups(docs):
    sets = [shingle_set(t) for _, t in docs]
    root, links = list(range(len(docs))), [0] * len(docs)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(docs):
        least[find(k)].append(i)
    return {i: (min(least[find(k)]), links[k]) for k, (i, _) in enumerate(docs)}


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies(words):
    base = [words(120 + 10 * k, k) for k in range(6)]
    texts = [*base, base[0], base[0], "", None, "one", "one", "a b c d e", "a b c d e"]
    texts += [edited(base[1], k % 4, k) for k in range(25)] + [edited(base[2], 1, 100 + k) for k in range(10)] + [edited(base[3], 6 + k, 200 + k) for k in range(6)]
    texts += [" ".join(base[4].split()[: 130 + k]) for k in range(12)]
    return list(enumerate(texts))


@pytest.mark.parametrize("kw", [{}, {"block": 4, "few": 0}])
def test_copy_groups(make_docs, copies, kw):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows(forest.copy_groups(make_docs(copies), forest.Forest(**kw)))}
    assert got == plain_groups(copies)


@pytest.mark.parametrize("kw", [{"block": 6, "few": 2}])
def test_stars(make_docs, words, kw):
    """A crowd around one text: at all distances, some within half of the allowed one."""
    base = words(200, 5)
    docs = [base, base, *(edited(base, k % 9, 40 + k) for k in range(40)), *(edited(base, 20, 400 + k) for k in range(8)), words(150, 6)]
    docs = list(enumerate(docs))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows(forest.copy_groups(make_docs(docs), forest.Forest(**kw)))}
    assert got == plain_groups(docs)


def test_recall_of_the_tries():
    """Of pairs at the threshold the tries bring together as many as wanted, the statistic for giving up included."""
    r = np.random.default_rng(6)
    cfg = forest.Forest()
    pool = r.integers(0, 2**63, (4000, 2, 100)).astype(np.uint64)
    met = 0
    for x in pool:
        common = x[0, :80]
        sets = [np.concatenate([common, x[0, 80:90]]), np.concatenate([common, x[1, 80:90]])]  # 80 of 100
        a, b = (forest.signatures(v, np.array([0, len(v)]), cfg)[0].astype(np.int64) for v in sets)
        same = (a == b).reshape(cfg.trees, cfg.deepest)
        met += same[:, : cfg.depth()].all(1).any() and same.sum() >= cfg.least_equal()
    assert met >= 0.999 * len(pool)


def test_parts_of_a_group_are_compared_too(monkeypatch):
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 300 - 3 * k], r.integers(0, 2**63, 5).astype(np.uint64)])) for k in range(12)]
    cfg = forest.Forest()
    sig = [forest.signatures(x, np.array([0, len(x)]), cfg)[0].tobytes() for x in sets]
    n = len(sets)
    g = pa.table({"t": [0] * n, "p": [0] * n, "i": [0] * n, "j": [0] * n, "block": [0] * n, "star": pa.array([None] * n, pa.binary()), "sig": pa.array(sig, pa.binary()), "shingles": pa.array([x.tobytes() for x in sets], pa.binary())})
    whole = forest.linked(g, cfg)[0]
    want = [[a != b and len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) for b, y in enumerate(sets)] for a, x in enumerate(sets)]
    assert (whole == (np.array(want) & forest.likely(g, cfg)[0])).all() and whole.any()
    for most in (100, 700, 2000):
        monkeypatch.setattr(forest, "MOST_SHINGLES", most)
        assert (forest.linked(g, cfg)[0] == whole).all()


def test_one_of_each_group_stays(make_docs, copies):
    kept = sorted(r["doc_id"] for r in rows(forest.without_copies(make_docs(copies))))
    assert kept == sorted({g for g, _ in plain_groups(copies).values()})
    twice = make_docs([*copies, *copies])
    assert sorted(r["doc_id"] for r in rows(forest.without_copies(twice))) == kept


def test_prefixes_are_shortened_to_the_recall():
    assert forest.Forest(recall=0.5).depth() > forest.Forest(recall=0.9995).depth() >= 1
    f = forest.Forest()
    assert 1 - (1 - 0.8 ** f.depth()) ** f.trees >= f.recall


def test_odd_rows_as_copies(odd_docs):
    got = forest.copy_groups(odd_docs)
    assert got.count() == odd_docs.count()
    empty = odd_docs.limit(0)
    assert forest.copy_groups(empty).count() == 0 and forest.without_copies(empty).count() == 0
    kept = forest.without_copies(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1


# ---- repeated byte strings -------------------------------------------------------------------


def plain_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.fixture(scope="module")
def pasted(words):
    r = random.Random(9)
    parts = [words(30, 70 + k) for k in range(5)]
    texts = [words(r.randint(5, 60), 300 + k) + " " + r.choice(parts)[r.randint(0, 20) :] + " é東 " + words(r.randint(5, 40), 400 + k) for k in range(40)]
    return [*texts, texts[0], texts[1], texts[1], "", None, "short", "ab" * 300, "x" * 500, "x" * 90, words(200, 1) + words(200, 1)]


@pytest.mark.parametrize("most", [4096, 3])
def test_repeats_are_removed(make_docs, pasted, most):
    rule = repeats.Rule(length=60, gram=8, most=most, shard_bytes=2000)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(repeats.remove_repeats(make_docs(pasted), rule))}
    assert [got[k] for k in range(len(pasted))] == plain_removal(pasted, 60)


def test_kept_bytes(make_docs, pasted):
    rule = repeats.Rule(length=60, gram=8)
    for r in rows(repeats.remove_repeats(make_docs(pasted), rule, texts=True)):
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


def plain_passages(texts, n):
    """Words of each text in runs of n words that a different row's text has too."""
    words = [(t or "").encode().split() for t in texts]
    own = collections.defaultdict(set)
    for k, w in enumerate(words):
        for i in range(len(w) - n + 1):
            own[tuple(w[i : i + n])].add(k)
    out = []
    for w in words:
        hit = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if len(own[tuple(w[i : i + n])]) > 1:
                hit[i : i + n] = True
        out.append(int(hit.sum()))
    return out


@pytest.mark.parametrize(("n", "gram"), [(20, 8), (9, 2)])
def test_passages_of_other_rows(make_docs, words, pasted, n, gram):
    u, p, v, w, z = (words(3 * n, 900 + i) for i in range(5))
    pasted = [*pasted, " ".join((u, p, v, w, p, z)), " ".join((w, p, z))]  # an own repeat that another row has too
    texts = [*pasted, "the " * 300, "x the " + "the " * n + "y", "the " * (n - 1), pasted[3].replace(" ", "\n", 7)]
    rule = repeats.Rule(length=60, gram=8, words=n, word_gram=gram)
    got = {r["doc_id"]: r["n_passage_words"] for r in rows(repeats.remove_repeats(make_docs(texts), rule))}
    assert [got[k] for k in range(len(texts))] == plain_passages(texts, n)


def test_words_and_their_texts():
    texts = [b"", b"one", b" two  three\tfour", b"", b"five six ", b"\x0b\r\n"]
    off = np.cumsum([0, *map(len, texts)])
    codes, woff = repeats.words_of(np.frombuffer(b"".join(texts), np.uint8), off)
    want = [w for t in texts for w in t.split()]
    assert np.diff(woff).tolist() == [len(t.split()) for t in texts] and len(codes) == len(want)
    assert len(set(codes.tolist())) == len(set(want))
    again, _ = repeats.words_of(np.frombuffer(b"three", np.uint8), np.array([0, 5]))
    assert again[0] == codes[2]


def test_windows_by_suffix_array():
    r = random.Random(4)
    rule = repeats.Rule(length=40, gram=8)
    for _ in range(25):
        alphabet = r.choice([b"ab", b"abcdefgh"])
        base = [bytes(r.choice(alphabet) for _ in range(r.randint(30, 200))) for _ in range(5)]
        blocks = list({b"".join(r.choice(base)[r.randint(0, 20) :][: r.randint(30, 120)] for _ in range(3)) for _ in range(8)})
        blocks = [b for b in blocks if len(b) >= 40]
        seen = collections.Counter(b[i : i + 40] for b in blocks for i in range(len(b) - 39))
        for b, starts in zip(blocks, repeats.repeated_windows(blocks, rule), strict=True):
            assert starts.tolist() == [i for i in range(len(b) - 39) if seen[b[i : i + 40]] > 1]


@pytest.mark.parametrize("until", [5, 12, 16])
def test_suffixes_are_refined_just_so_far(until):
    from planloom.llm.suffixes import refine

    r = random.Random(until)
    for _ in range(40):
        blocks = [[r.randint(1, 3) for _ in range(r.randint(1, 40))] for _ in range(4)]
        x = sum(blocks, [])
        room = np.concatenate([np.arange(len(b), 0, -1) for b in blocks])
        for wide in (None, room):
            sa, rank = refine(np.array(x, np.int64), 1, until=until, room=wide)
            assert sorted(sa.tolist()) == list(range(len(x)))
            real = [i for i in range(len(x)) if room[i] >= until]
            for i in real:
                for j in real:
                    assert (rank[i] < rank[j]) == (x[i : i + until] < x[j : j + until])


def test_blocks_hold_every_window(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 64)
    r = random.Random(6)
    for slice_ in (1 << 22, 150):
        monkeypatch.setattr(repeats, "SLICE", slice_)
        base = [bytes(r.choice(b"ab") for _ in range(70)) for _ in range(4)]
        texts = [b"", b"x" * 39, b"y" * 200, *(b"".join(r.choice(base) for _ in range(r.randint(0, 4))) for _ in range(20)), b"", b"z" * 40, b""]
        off = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        windows, mark = [], {}
        for text, start, size, m, at, _, _ in repeats.blocks_of(repeats.BYTE[data], off, 40, 8):
            assert (at == off[text] + start).all()
            for k, a, n, h in zip(text.tolist(), start.tolist(), size.tolist(), m.tolist(), strict=True):
                for i in range(a, a + n - 39):
                    windows.append((k, i))
                    assert mark.setdefault(texts[k][i : i + 40], h) == h
        assert windows == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 39)]


def test_windows_cost_a_few_sorts(words):
    """Of near copies, as a crowded minimiser has them."""
    import time

    text = words(60_000, 8).encode()
    r = random.Random(8)
    blocks = [text[a : a + 590] for a in (r.randrange(400) + 600 * r.randrange(40) for _ in range(440))]
    keys = np.random.default_rng(8).integers(0, 1 << 62, sum(map(len, blocks)))

    def seconds(run):
        times = []
        for _ in range(5):
            t = time.process_time()
            run()
            times.append(time.process_time() - t)
        return min(times)

    assert seconds(lambda: repeats.repeated_windows(blocks, repeats.Rule())) < 6 * seconds(lambda: np.argsort(keys, kind="stable"))


def test_fingerprints_tell_windows_apart():
    r = random.Random(5)
    blocks = [bytes(r.choice(b"ab") for _ in range(80)) for _ in range(50)]
    prints = {}
    for b in blocks:
        for i, key in enumerate(zip(*repeats.fingerprints(repeats.BYTE[np.frombuffer(b, np.uint8)], 40), strict=True)):
            assert prints.setdefault(key, b[i : i + 40]) == b[i : i + 40]
    assert len(prints) == len({b[i : i + 40] for b in blocks for i in range(41)})


def test_odd_rows_as_repeats(odd_docs):
    assert repeats.remove_repeats(odd_docs).count() == odd_docs.count()
    assert repeats.remove_repeats(odd_docs.limit(0)).count() == 0


# ---- WARC ------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def plain_records(pages):
    top = collections.defaultdict(lambda: None)
    for k, _, h in pages:
        if len((h or "").encode()) >= 1000 and k is not None:
            top[h] = k if top[h] is None else max(top[h], k)
    out = []
    for k, _, h in pages:
        raw = (h or "").encode()
        to = top[h] if len(raw) >= 1000 and k != top[h] else None
        out.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_archives_read_back(spark, words):
    big = words(400, 1)
    pages = [(1, "http://a/", big), (5, "http://b/\r\nX: y", big), (3, None, big), (2, "http://c/", "small"), (4, "http://d/", "small"), (6, "http://e/", None), (7, "http://f/", ""), (None, "http://g/", big), (8, "http://h/", "é" * 600), (9, "http://i/ ü", "é" * 600), (5, "http://b/2", big), (None, "u", "tiny")]
    index = warc.write_archives(spark.createDataFrame(pages, PAGES))
    assert index.count() == len(pages) and index.where("file is null or length <= 0").count() == 0
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    for kw in ({}, {"gap": 0, "most": 1}, {"block": 100}):
        got = sorted((tuple(r[f] for f in fields) for r in rows(warc.read_records(index, **kw))), key=str)
        assert got == plain_records(pages)
    html = {r["page_id"]: r["html"] for r in rows(warc.read_records(index.where("page_id = 5 or page_id = 6"), payloads=True))}
    assert html == {5: big, 6: ""}
    assert warc.write_archives(spark.createDataFrame([], PAGES).withColumn("digest", F.lit("clash"))).count() == 0


def test_a_damaged_record_is_noticed(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame([(1, "u", "text")], PAGES), folder=f"file://{tmp_path}/w")
    row = index.first()
    system, path = warc.file_system(row["file"])
    import gzip

    raw = gzip.decompress(system.open_input_file(path).read())
    bad = gzip.compress(raw.replace(b"text\r\n", b"tuxt\r\n"), 6, mtime=0)
    with system.open_output_stream(path, compression=None) as f:
        f.write(bad)
    moved = index.withColumn("length", F.lit(len(bad)).cast("long"))
    with pytest.raises(Exception, match="digest"):
        warc.read_records(moved).collect()


def test_records_are_warc(spark):
    raw = warc.record(1, "http://a/", b"body", hashlib.sha1(b"body").hexdigest(), None, False, "2024-01-01T00:00:00Z")
    fields, block = warc.parse(raw)
    assert fields["warc-type"] == "response" and block.endswith(b"\r\n\r\nbody") and int(fields["content-length"]) == len(block)
    with pytest.raises(ValueError):
        warc.parse(raw[:-8])
    assert pa.array([1])  # pyarrow is what reads the archives


def test_clashing_columns_pass_through(odd_docs):
    assert {r["_k"] for r in forest.without_copies(odd_docs).select("_k").collect()} == {"clash"}
