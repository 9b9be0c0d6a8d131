"""Operators that look at one document at a time, against plain versions of the same rules."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from planloom.llm import contamination, language, lattice, pii, quality, queries, repetition, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- token counts ----------------------------------------------------------------------------

TRICKY = ["", "'s", "'re", "a'r", "don't they'll we've I'm x'd", "''s 's \n's\t's", "  two  spaces\n\n x\t\t", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>", "   ", "a b", "\x1cx\x1d y", "é東京 ١٢٣ ½²", "'l", "x'll'll's'sx'rex'vexx'", "😀😀 áb", "a" * 3000, "!?" * 500, " 'll", "1's2'l l", "　　x", "tail'r"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    return TRICKY + ["".join(r.choice("aest'rlvmd  \n\t12.!é東 😀<|") for _ in range(r.randint(1, 40))) for _ in range(1500)]


def test_token_counts_equal_the_library(make_docs, texts):
    from tokenizers import Tokenizer

    want = [len(e.ids) for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    got = {r["doc_id"]: r for r in rows(token_counts.token_counts(make_docs(texts), BPE, limit=30))}
    assert [got[k]["n_tokens"] for k in range(len(texts))] == want
    assert all(got[k]["n_bytes"] == len(t.encode()) and got[k]["over_limit"] == (want[k] > 30) for k, t in enumerate(texts))


def test_splitter_does_not_depend_on_chunks(texts):
    chars = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    c = token_counts.char_classes()[chars]
    whole = token_counts.marks(c, width=1 << 20)
    assert all((token_counts.marks(c, width=w) == whole).all() for w in (1, 7, 256))


def test_dropping_compiled_states_changes_nothing(texts):
    import pyarrow as pa

    m = token_counts.Counter(BPE)
    a = token_counts.count_pack(m, pa.array(texts))
    m.MOST_STATES = 0
    assert (token_counts.count_pack(m, pa.array(texts)) == a).all()


# ---- personal data ---------------------------------------------------------------------------

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(v if v < 10 else v - 9 for i, c in enumerate(d[::-1]) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def plain_spans(t):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(t):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_the_patterns():
    r = random.Random(2)
    for _ in range(20_000):
        alphabet = r.choice(["a.@b-. 1", "0123.256 ", "4-1 0", "+1(2).3- x", "a@.1-+ 25"])
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t), t


@pytest.mark.parametrize(
    "text, found",
    [
        ("mail john.doe [at] example [dot] com now", [("email", "john.doe [at] example [dot] com")]),
        ("john at example dot com", [("email", "john at example dot com")]),
        ("look at the dot on the page", []),
        ("joe at mail.example.com", []),
        ("ｊｏｈｎ＠example．com", [("email", "ｊｏｈｎ＠example．com")]),
        ("call plus one two one two five five five zero one nine nine ok", [("phone", "plus one two one two five five five zero one nine nine")]),
        ("card four one one one 1111 one one one one one one one one ok", [("card", "four one one one 1111 one one one one one one one one")]),
        ("ip one nine two dot one six eight dot one dot one.", [("ip", "one nine two dot one six eight dot one dot one")]),
        ("192​.168.1.1", [("ip", "192​.168.1.1")]),
        ("+٤٩ ١٢٣ ٤٥٦ ٧٨٩٠", [("phone", "+٤٩ ١٢٣ ٤٥٦ ٧٨٩٠")]),
        ("one two three apples", []),
        ("plus four nine double seven twenty three ninety triple zero fifteen", [("phone", "plus four nine double seven twenty three ninety triple zero fifteen")]),
        ("ip ten dot twenty five dot one double zero dot seven ok", [("ip", "ten dot twenty five dot one double zero dot seven")]),
        ("contact jo at acme dot zebra now", [("email", "jo at acme dot zebra")]),
        ("they met jo at acme dot zebra now", []),
        ("in nineteen ninety nine a double bed", []),
    ],
)
def test_disguises(text, found):
    base, more = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in base + more] == found


@pytest.mark.parametrize(
    "text, base, more, masked",
    [
        ("to jоhn@example.com now", ["hn@example.com"], ["jоhn@example.com"], "to <email> now"),
        ("to john@exаmple.com now", [], ["john@exаmple.com"], "to <email> now"),
        ("+49 170 1234 five six seven ok", ["+49 170 1234"], ["+49 170 1234 five six seven"], "<phone> ok"),
        ("a@b.co dot uk, 10.0.0.1 one two three", ["a@b.co", "10.0.0.1"], ["a@b.co dot uk"], "<email>, <ip> one two three"),
        ("é a@b.co и c@d.co", ["a@b.co", "c@d.co"], [], "é <email> и <email>"),
    ],
)
def test_identifiers_longer_than_their_base_span(text, base, more, masked):
    found = pii.find(text)
    assert [[text[a:b] for _, a, b in spans] for spans in found] == [base, more]
    assert pii.mask(text) == masked


@pytest.mark.parametrize("text", ["john [@] example [.] com", "john[@]example.com", "john(@)example{.}com", "ann @ work <.> 192[.]168[.]1[.]1"])
def test_bracketed_marks(text):
    base, more = pii.find(text)
    assert base == [] and [text[a:b] for _, a, b in more] == [text[text.find("192") :] if "192" in text else text]


@pytest.mark.parametrize("label", "dev ai jp cn ru br in au cloud app com xn--p1ai".split())
def test_spelled_addresses_of_any_label(label):
    text = f"write jane at acme dot {label} today"
    assert [text[a:b] for _, a, b in pii.find(text)[1]] == [f"jane at acme dot {label}"]
    assert pii.mask(text.replace(" at ", "@")) == "write <email> today"


@pytest.mark.parametrize("text", ["look at the dot in the middle", "start at this point in time", "stop at boiling point in winter", "be at some point so", "look at red dot matrices", "chez nous point va"])
def test_sentences_are_no_addresses(text):
    assert pii.find(text) == ([], [])


def test_pii_query(make_docs):
    texts = ["a@b.co 10.0.0.1", "", None, "é a@b.co and john at example dot com"]
    got = {r["doc_id"]: r for r in rows(pii.pii_spans(make_docs(texts)))}
    assert (got[0]["n_email"], got[0]["n_ip"], got[0]["n_card"], got[0]["n_phone"]) == (1, 1, 0, 0)
    assert got[0]["base_sha256"] == hashlib.sha256(b"email:0:6,ip:7:15").hexdigest()
    assert got[1]["base_sha256"] == got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[2]["spans"] == ""
    assert got[3]["n_email"] == 1 and got[3]["n_added"] == 1 and got[3]["spans"].startswith("email:2:8,")


def test_masking(make_docs):
    got = {r["doc_id"]: r for r in rows(pii.mask_pii(make_docs(["mail a@b.co!", None, "plain"])))}
    assert got[0]["text"] == "mail <email>!" and got[0]["n_chars"] == 13 and got[1]["text"] is None and got[2]["text"] == "plain"


# ---- repetition ------------------------------------------------------------------------------


def plain_repetition(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(words)
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    hit = {j for i in range(n - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    long = collections.Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    covered = {j for i in range(n - 7) if long[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    best = 0
    for size in range(1, n):
        seen = collections.Counter(tuple(words[i : i + size]) for i in range(n - size + 1))
        if max(seen.values()) < 2:
            break
        best = size
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_covered": len(covered), "longest_repeat": best}


def test_repetition(make_docs, words):
    r = random.Random(3)
    texts = ["", "a", "a a a a a a a a a a a a", "x\nx\n \n\ny y x", "b c d b c d b c", words(300, 1), words(100, 2) + " " + words(60, 3) + "\n" + words(100, 2)]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(1, 60))) for _ in range(60)]
    got = {r["doc_id"]: r for r in rows(repetition.repetition_rules(make_docs(texts)))}
    for k, t in enumerate(texts):
        want = plain_repetition(t)
        assert {x: got[k][x] for x in want} == want, t
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert got[k]["base_failed"] == failed and (not failed or not got[k]["kept"])
    assert got[5]["kept"] and not got[6]["kept"]


def plain_maximal(symbols, least):
    """Every repeated substring of `least` symbols that can't be extended on either side in all its places."""
    n, out = len(symbols), {}
    for size in range(least, n):
        places = collections.defaultdict(list)
        for i in range(n - size + 1):
            places[tuple(symbols[i : i + size])].append(i)
        for at in places.values():
            left = {symbols[i - 1] if i else ("edge", i) for i in at}
            right = {symbols[i + size] if i + size < n else ("edge", i) for i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                for i in at:
                    out[i] = max(out.get(i, 0), size)
    return out


def test_maximal_repeats():
    from planloom.llm.suffixes import common_prefixes, refine

    r = random.Random(12)
    for _ in range(200):
        x = [r.randint(0, r.choice([1, 2, 5])) for _ in range(r.randint(1, 40))]
        levels = []
        sa, _ = refine(np.array(x, np.int64), 1, levels=levels)
        before = np.array([-1 if i == 0 else x[i - 1] for i in sa.tolist()])
        for least in (1, 2, 4):
            reach, lengths = repetition.maximal_repeats(common_prefixes(sa, levels), before, least)
            assert {int(i): int(v) for i, v in zip(sa, reach, strict=True) if v} == plain_maximal(x, least)
            assert (lengths >= least).all()


# ---- quality and language --------------------------------------------------------------------


def plain_features(text, bits):
    """The feature numbers of a text, one word after the other."""
    mask, out, last = (1 << bits) - 1, collections.Counter(), 0
    mix = lambda v: int(quality.mix64(np.array([v % 2**64], np.uint64))[0])
    for w in quality.TOKEN.findall(text):
        form = 5 if w.isdigit() else 6 if not w[0].isalnum() else 3 if w.islower() else 2 if len(w) > 1 and w.isupper() else 4 if w.istitle() else 7
        word = zlib.crc32(w.lower().encode())
        code = word | form << 32
        out[mix(word) & mask] += 1
        out[1 if code == last else mix((last & 0xFFFFFFFF) * 31 + word + (1 << 40)) & mask] += 1
        out[mix((last >> 32 << 8) + form + (1 << 41)) & mask] += 1
        last = code
    return out


def test_scores_are_those_of_plain_ftrl(make_docs, words):
    """Learning and scoring in dictionaries, a number at a time."""
    texts = [words(30, k) if k % 3 else f"BAD {k} !!! {words(4, k)} !!!" for k in range(60)] + ["", None, "NEVER seen"]
    cfg = quality.Ftrl(bits=14, epochs=3)
    n, z = collections.defaultdict(float), collections.defaultdict(float)
    known = sorted(range(60), key=lambda k: (zlib.crc32(str(k).encode()), str(k)))
    y = {k: float(k % 3 > 0) for k in known}
    rows_ = {k: {f: c / sum(x.values()) * cfg.scale for f, c in x.items()} for k in known for x in [plain_features(texts[k], 14)]}
    rows_ = {k: {f: float(np.float32(v / cfg.scale)) * cfg.scale for f, v in x.items()} for k, x in rows_.items()}
    share = sum(y.values()) / 60
    bias, bias_n = float(np.log(share / (1 - share))), 0.0
    weight = lambda f: 0.0 if abs(z[f]) <= cfg.l1 else -(z[f] - np.sign(z[f]) * cfg.l1) / ((cfg.beta + n[f] ** 0.5) / cfg.alpha + cfg.l2)
    for _ in range(3):
        for k in known:
            w = {f: weight(f) for f in rows_[k]}
            p = 1 / (1 + np.exp(-(bias + sum(w[f] * v for f, v in rows_[k].items()))))
            for f, v in rows_[k].items():
                g = (p - y[k]) * v
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / cfg.alpha * w[f]
                n[f] += g * g
            bias_n += (p - y[k]) ** 2
            bias -= 0.1 * (p - y[k]) / (1 + bias_n**0.5)
    docs = make_docs(texts)
    labels = docs.sparkSession.createDataFrame([(k, int(y[k])) for k in known], "doc_id long, quality int")
    model = quality.fit(docs, labels, cfg, F.lit(True))
    got = {r["doc_id"]: r for r in rows(quality.quality_scores(docs, *model, cfg, ["doc_id"]))}
    for k, t in enumerate(texts):
        f = plain_features(t or "", 14)
        want = 1 / (1 + np.exp(-(bias + cfg.scale * sum(weight(x) * c for x, c in f.items()) / max(1, sum(f.values())))))
        assert got[k]["score"] == pytest.approx(want, abs=1e-4) and got[k]["predicted"] == int(got[k]["score"] >= cfg.threshold)
    kept = {r["doc_id"] for r in rows(quality.passing(docs, *model, cfg))}
    assert kept == {k for k in got if got[k]["predicted"]}


def test_fewer_features_than_the_sample_has(make_docs, words):
    docs = make_docs([words(30, k) for k in range(20)])
    labels = docs.sparkSession.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    none = quality.fit(docs, labels, quality.Ftrl(most_features=0), F.lit(True))
    assert not none[0].any() and none[1] == 0.0
    assert quality.fit(docs, labels, quality.Ftrl(most_features=500), F.lit(True))[0].any()


def test_language_scores_are_plain_cosines(make_docs, words):
    """The nearest of the model's centroids by a cosine taken word by word; and centroids are means."""
    cfg = language.Settings(bits=9, centroids=2, rounds=3)
    other = ["zwölf große vögel fliegen über das haus " * (1 + k % 3) + str(k) for k in range(12)]
    texts = [words(40, k) for k in range(12)]
    docs = make_docs(texts, "en").unionByName(make_docs([(100 + k, t) for k, t in enumerate(other)], "de"))
    model = language.fit(docs, cfg, F.lit(True))
    assert sorted(set(model.langs)) == ["de", "en"] and len(model.langs) <= 4

    def grams(t):
        low, out = t.lower(), collections.Counter()
        padded = "".join(c if c.isalpha() else " " for c in low) + "   "
        for size in cfg.sizes:
            for i in range(len(padded) - size + 1):
                g = padded[i : i + size]
                if g.strip():
                    h = size
                    for c in g:
                        h = (h * 0x100000001B3 + ord(c)) % 2**64
                    out[int(language.mix64(np.array([h], np.uint64))[0]) % 512] += 1
        return out

    every = [*texts, *other]
    df = collections.Counter(k for t in every for k in grams(t))
    idf = [np.log((1 + len(every)) / (1 + df[k])) + 0.1 for k in range(512)]
    assert np.allclose(model.idf, idf, atol=1e-5)
    vector = lambda t: {k: np.log1p(c) * idf[k] for k, c in grams(t).items()}
    asked = [*texts[:5], *other[:5], "haus", "the on er", "x"]
    got = {r["doc_id"]: r for r in rows(language.predict(make_docs(asked), model, cfg, ["doc_id"]))}
    for k, t in enumerate(asked):
        v = vector(t)
        norm = sum(x * x for x in v.values()) ** 0.5
        cos = [sum(x * float(c[d]) for d, x in v.items()) / norm for c in model.centroids]
        assert got[k]["score"] == pytest.approx(max(max(cos), 0), abs=1e-4)
        best = [model.langs[i] for i, c in enumerate(cos) if c > max(cos) - 1e-5]
        assert got[k]["lang_pred"] in best and got[k]["rejected"] == (got[k]["score"] < model.floor[model.langs.index(got[k]["lang_pred"])])
    x = language.tfidf(language.tf_vectors(texts, cfg)[0], model.idf)
    mine = model.centroids[[i for i, n in enumerate(model.langs) if n == "en"]]
    near = (x @ mine.T).argmax(1)
    assert all(np.allclose(mine[i] / np.linalg.norm(mine[i]), mine[i], atol=1e-4) for i in range(len(mine))) and set(near) == set(range(len(mine)))


def learned(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 != 2


def test_quality_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    scores = queries.op1_quality_classifier(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = rows(scores.join(labels, "doc_id").where("held_out"))
    assert scores.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r["held_out"] == (not learned(r["doc_id"])) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95


def test_held_out_labels_teach_nothing(spark, make_docs):
    docs = make_docs([f"good text {k}" if k % 2 else f"bad!! text {k}" for k in range(200)])
    cfg = quality.Ftrl(bits=12, epochs=2)
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    flipped = spark.createDataFrame([(k, k % 2 if learned(k) else 1 - k % 2) for k in range(200)], "doc_id long, quality int")
    a, b = (quality.fit(docs, x, cfg, ~queries.held_out()) for x in (labels, flipped))
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_language_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = rows(queries.op9_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out"))
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_without_letters(spark, make_docs, words):
    known = make_docs([words(50, k) for k in range(40)])
    model = language.fit(known, language.Settings(), F.lit(True))
    got = {r["doc_id"]: r for r in rows(language.predict(make_docs([None, "", "123 !?", "the er on"]), model, language.Settings(), ["doc_id"]))}
    assert [got[k]["lang_pred"] for k in range(4)] == ["und", "und", "und", "en"] and got[0]["score"] == 0
    none = language.fit(known.limit(0), language.Settings(), F.lit(True))
    assert {r["lang_pred"] for r in rows(language.predict(known, none, language.Settings(), ["doc_id"]))} == {"und"}


# ---- decontamination -------------------------------------------------------------------------


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_contamination(spark, make_docs, words):
    items = [words(n, 100 + n) for n in (5, 9, 14, 20, 35, 59, 80)] + ["too few words", None, ""]
    docs = [words(3000, 7), None, "", *items[:3], *(words(r, 8 + r) + " " + t + " " + words(2000 - r, 9 + r) for r, t in enumerate(items[:7]))]
    changed = items[5].split()
    changed[3] = changed[40] = "zzz"
    docs += [words(500, 50) + " " + " ".join(changed) + " " + words(700, 51), words(100, 52) + " " + " ".join(items[5].split()[:30])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(k, i) for k, t in enumerate(docs) for i, x in enumerate(items) if t and x and shingles(x) and len(shingles(x) & shingles(t)) >= 0.8 * len(shingles(x))}
    got = {(r["doc_id"], r["item_id"]) for r in rows(contamination.contaminated(make_docs(docs), bench))}
    assert got == want and len(want) > 10
    few = contamination.Search(most_chars=200)
    assert {(r["doc_id"], r["item_id"]) for r in rows(contamination.contaminated(make_docs(docs), bench, few))} == want
    clean = {r["doc_id"] for r in rows(contamination.decontaminate(make_docs(docs), bench, few))}
    assert clean == set(range(len(docs))) - {k for k, _ in want}
    assert contamination.contaminated(make_docs(docs), bench.limit(0)).count() == 0


# ---- sentencepiece ---------------------------------------------------------------------------


def test_samples_decode_and_differ(make_docs, words):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [words(300, 1), "", " ", "  a  b\t\nc ﬁ ① é", "😀x", "東京", "a"]
    got = {r["doc_id"]: r for r in rows(lattice.sampled_segmentations(make_docs(texts), MODEL, k=4))}
    for k, t in enumerate(texts):
        r = got[k]
        assert r["round_trip"] and all(sp.decode(ids) == t for ids in r["ids"])
        assert len({tuple(ids) for ids in r["ids"]}) == len(r["ids"]) == len(r["log_prob"])
        assert r["perturbed"] == sorted(r["perturbed"], reverse=True)
        assert r["n_pieces"] == [len(ids) for ids in r["ids"]] and all(0 <= q <= 1 for q in r["inclusion"])
        assert r["ids_sha256"] == [hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest() for ids in r["ids"]]
    assert got[1]["ids"] == [[]] and got[1]["inclusion"] == [1.0]
    again = {r["doc_id"]: r for r in rows(lattice.sampled_segmentations(make_docs(texts).repartition(5), MODEL, k=4))}
    assert again == got
    decoded = lattice.decoded(lattice.sampled_segmentations(make_docs(texts), MODEL, k=1).select("doc_id", F.element_at("ids", 1).alias("ids")), MODEL)
    assert {r["doc_id"]: r["text"] for r in rows(decoded)} == dict(enumerate(texts))


def test_sampling_is_without_replacement_by_probability():
    n = 12_000
    model = lattice.pieces(MODEL)
    lat, found = lattice.sample_pack(model, ["hello"] * n, lattice.text_keys([str(i) for i in range(n)], 1), 2)
    every = {}

    def walk(place, log_p, path):
        if place == -1:
            every[path] = np.exp(log_p)
            return
        for e in range(lat.eo[place], lat.eo[place + 1]):
            walk(int(lat.next[e]), log_p + lat.log_p[e], (*path, e))

    walk(0, 0.0, ())
    assert sum(every.values()) == pytest.approx(1)
    first, second = (collections.Counter(tuple(s[k][0].tolist()) for s, _ in found) for k in (0, 1))
    for path, p in sorted(every.items(), key=lambda x: -x[1])[:3]:
        later = sum(q * p / (1 - q) for o, q in every.items() if o != path)
        assert first[path] / n == pytest.approx(p, abs=0.015) and second[path] / n == pytest.approx(later, abs=0.015)


@pytest.mark.parametrize("text", ["c  d", "c   d", "  c", "d  ", "a" + " " * 5, "a  b", "\t\t  x"])
def test_runs_of_spaces_have_their_pieces(text):
    """Every segmentation into pieces is drawn in the end, the library's own included."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    full = ("\u2581" + text.replace(" ", "\u2581")).replace("\t", "\0")
    usable = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}

    def splits(t):
        if not t:
            return [()]
        return [(t[:n], *rest) for n in range(1, len(t) + 1) if n == 1 or t[:n] in usable for rest in splits(t[n:])]

    want = set(splits(full))
    model = lattice.pieces(MODEL)
    # the other texts end in spaces, or are empty: no word may reach from one text into the next
    texts = ["z  ", text, "", text + " "]
    lat, found = lattice.sample_pack(model, texts, lattice.text_keys(list("abcd"), 0), len(want) + 5)
    samples, kappa = found[1]
    drawn = [tuple(lattice.ids_of(model, lat, s[0], text).tolist()) for s in samples]
    assert len(drawn) == len(set(drawn)) == len(want) and tuple(sp.encode(text)) in drawn
    assert kappa == -np.inf and sum(np.exp(s[1]) for s in samples) == pytest.approx(1)
    assert all(lattice.decodes_to(model, np.array(ids), text.encode()) for ids in drawn)


def test_fewer_segmentations_than_samples():
    model = lattice.pieces(MODEL)
    lat, ((samples, kappa),) = lattice.sample_pack(model, ["hello"], lattice.text_keys(["1"], 0), 1000)
    assert len(samples) < 1000 and kappa == -np.inf and sum(np.exp(s[1]) for s in samples) == pytest.approx(1)


def test_lumps_open_up():
    """Texts whose only choices come late are sampled right too."""
    model = lattice.pieces(MODEL)
    text = "\U0001f600͸" * 100 + "hello"
    lat, found = lattice.sample_pack(model, [text] * 400, lattice.text_keys([str(i) for i in range(400)], 3), 3)
    assert all(len({s[0].tobytes() for s in samples}) == len(samples) == 3 for samples, _ in found)


@pytest.mark.parametrize("collide", [False, True])
def test_common_endings_are_weighed_once(monkeypatch, collide):
    """A pack's places are its words' distinct endings, and each has the numbers that it has in a lattice of its own."""
    model, keys = lattice.pieces(MODEL), lattice.text_keys(["1"], 0)
    words = ["a\u0378tion", "nation", "on", "ration", "station", "x"]
    text = " ".join([*words, "station"])
    alone = [lattice.sample_pack(model, [w], keys, 1)[0] for w in words]
    size, calls, good = len(text) + 1 - len(" station"), [], lattice.mix64

    def bad(x):
        calls.append(len(x))
        return x >> np.uint64(32) if len(x) == size and calls.count(size) == 1 else good(x)

    if collide:  # the first hashes are no use: all endings of a size look equal
        monkeypatch.setattr(lattice, "mix64", bad)
    lat, found = lattice.sample_pack(model, [text], keys, 3)
    assert len(lat.eo) - 1 == len({(" " + w)[i:] for w in words for i in range(len(w) + 1)})
    assert calls.count(size) == (2 if collide else 0)

    def spelled(place):  # by edges of one character, which come first
        return "" if place == -1 else chr(lat.chars[place]) + spelled(int(lat.next[lat.eo[place]]))

    place_of = {spelled(p): p for p in range(len(lat.eo) - 1)}
    for word, own in zip(words, alone, strict=True):
        for i in range(len(word) + 1):
            p = place_of[("\u2581" + word)[i:]]
            mine, its = slice(*lat.eo[p : p + 2]), slice(*own.eo[i : i + 2])
            assert lat.piece[mine].tolist() == own.piece[its].tolist() and lat.log_p[mine].tolist() == own.log_p[its].tolist()
    assert all(lattice.decodes_to(model, lattice.ids_of(model, lat, s[0], text), text.encode()) for s in found[0][0])


# ---- odd rows --------------------------------------------------------------------------------


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


@pytest.fixture(scope="module")
def odd(odd_docs):
    """The odd rows with every name that an operator uses inside, or makes, as a clashing column."""
    names = "_t _k _y _id text_ text__ key key_ t x y n f score predicted lang_pred rejected spans n_removed kept ids n_pieces log_prob item_id containment".split()
    return odd_docs.withColumns({c: F.lit("clash") for c in names})


BENCH = [(1, "a b c d e f"), (2, None), (3, ""), (4, "too short"), (1, "a b c d e f")]


@pytest.mark.parametrize("name", ["tokens", "pii", "repetition", "sampled", "sampled with all", "quality", "quality with all", "language", "language with all"])
def test_odd_rows_each_give_a_row(odd, name):
    weights, cfg = np.zeros(1 << 18, np.float32), quality.Ftrl()
    every = [c for c in odd.columns if c != "text"]
    run = {
        "tokens": lambda d: token_counts.token_counts(d, BPE),
        "pii": pii.pii_spans,
        "repetition": repetition.repetition_rules,
        "sampled": lambda d: lattice.sampled_segmentations(d, MODEL, k=2),
        "sampled with all": lambda d: lattice.sampled_segmentations(d, MODEL, k=2, keep=every),
        "quality": lambda d: quality.quality_scores(d, weights, 0.0, cfg, ["doc_id"]),
        "quality with all": lambda d: quality.quality_scores(d, weights, 0.0, cfg),
        "language": lambda d: language.predict(d, language.fit(d, language.Settings(), F.lit(True)), language.Settings(), ["doc_id"]),
        "language with all": lambda d: language.predict(d, language.fit(d, language.Settings(), F.lit(True)), language.Settings(), every),
    }[name]
    got = run(odd)
    assert ids(got) == ids(odd)
    for c in set(got.columns) & {"_t", "_k", "key", "text_"}:
        assert {r[c] for r in got.select(c).collect()} == {"clash"}
    assert run(odd.limit(0)).collect() == []


def test_values_of_odd_rows(odd):
    by = lambda df, c: collections.Counter((r["doc_id"], r[c]) for r in df.collect())
    t = by(token_counts.token_counts(odd, BPE), "n_bytes")
    assert t == {(0, 0): 1, (1, 0): 1, (2, 5): 1, (3, 3): 2, (None, 11): 1, (None, 0): 1, (6, 200_000): 1, (7, 150_000): 1, (8, 17): 1, (8, 27): 1}
    w = by(repetition.repetition_rules(odd), "n_words")
    assert w == {(0, 0): 1, (1, 0): 1, (2, 0): 1, (3, 1): 2, (None, 6): 1, (None, 0): 1, (6, 1): 1, (7, 30_000): 1, (8, 3): 1, (8, 6): 1}
    assert {r["longest_repeat"] for r in repetition.repetition_rules(odd.where("doc_id = 7")).collect()} == {29_999}
    s = quality.quality_scores(odd, np.zeros(1 << 18, np.float32), 0.5, quality.Ftrl()).collect()
    assert all(r["score"] == pytest.approx(1 / (1 + np.exp(-0.5))) and r["predicted"] == 0 for r in s)
    assert {r["spans"] for r in pii.pii_spans(odd).collect()} == {""}
    u = language.predict(odd, language.Model(np.ones(1 << 13, np.float32), np.zeros((0, 1 << 13), np.float32), [], np.zeros(0)), language.Settings(), ["doc_id"]).collect()
    assert all((r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True) for r in u)
    p = {r["doc_id"]: r for r in lattice.sampled_segmentations(odd.where("doc_id < 3"), MODEL, k=2).collect()}
    assert p[0]["ids"] == p[1]["ids"] == [[]] and p[0]["round_trip"]
    twice = lattice.sampled_segmentations(odd.where("doc_id = 3"), MODEL, k=2).collect()
    assert twice[0] == twice[1]


def test_odd_rows_are_kept_or_dropped_whole(odd):
    bench = odd.sparkSession.createDataFrame(BENCH, "item_id long, text string")
    found = contamination.contaminated(odd, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["n_shared"]) for r in found] == [(None, 1, 2)] * 2
    for filtered, gone in ((contamination.decontaminate(odd, bench), 1), (quality.passing(odd, np.zeros(1 << 18, np.float32), 3.0, quality.Ftrl()), 0), (quality.passing(odd, np.zeros(1 << 18, np.float32), -3.0, quality.Ftrl()), 11), (pii.mask_pii(odd), 0)):
        assert filtered.columns == odd.columns and filtered.count() == odd.count() - gone
    assert {r["score"] for r in quality.passing(odd, np.zeros(1 << 18, np.float32), 3.0, quality.Ftrl()).collect()} == {"clash"}
    assert contamination.decontaminate(odd, bench.limit(0)).count() == odd.count()
    labels = odd.sparkSession.createDataFrame([(None, 1), (3, None), (7, 1), (8, 0), (8, 1), (99, 0)], "doc_id long, quality int")
    weights, bias = quality.fit(odd, labels, quality.Ftrl(), F.lit(True))
    assert weights.any() and np.isfinite(bias)
    empty = quality.fit(odd.limit(0), labels.limit(0), quality.Ftrl(), F.lit(True))
    assert not empty[0].any() and empty[1] == 0.0


# ---- disguises over a corpus -----------------------------------------------------------------


def test_disguises_of_a_corpus_are_found(words):
    """Addresses, numbers and hosts of many shapes in running prose: how many are found, and that
    prose alone has none."""
    r, found = random.Random(21), collections.Counter()
    names = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    forms = {
        "brackets": lambda u, h, e: f"{u} [at] {h} [dot] {e}",
        "round brackets": lambda u, h, e: f"{u}(at){h}(dot){e}",
        "plain words": lambda u, h, e: f"{u} at {h} dot {e}",
        "wide letters": lambda u, h, e: "".join(chr(ord(c) + 0xFEE0) for c in f"{u}@{h}.{e}"),
        "hidden characters": lambda u, h, e: f"{u}\u200b@{h}\u200b.{e}",
        "Cyrillic letters": lambda u, h, e: f"{u}@{h}.{e}".replace("a", "а").replace("o", "о").replace("e", "е"),
        "spelled digits": lambda u, h, e: "plus " + " ".join(r.choice(names) for _ in range(11)),
        "digits with signs": lambda u, h, e: "+49 " + " ".join(r.choice(names) if k % 2 else str(k) for k in range(10)),
    }
    n = 60
    for name, form in forms.items():
        for k in range(n):
            u, h, e = (words(1, 1000 + 3 * k + i).lower() for i in range(3))
            secret = form("x" + u, "y" + h, r.choice(["com", "org", "net", "io", "de", "app"]))
            text = f"{words(20, k)}. {secret}. {words(20, k + 500)}"
            at = text.index(secret)
            spans = [s for part in pii.find(text) for s in part]
            found[name] += any(a <= at and b >= at + len(secret) for _, a, b in spans)
    assert all(found[name] >= 0.95 * n for name in forms), found
    assert not any(any(pii.find(words(200, k))) for k in range(200))
