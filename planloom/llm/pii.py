"""Personal data, also in disguise: normalise with offsets, detect, map the spans back."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, packs, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile("[0-9]")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters that look like Latin ones but have no compatibility decomposition.
LOOKALIKES = dict(zip("аеорсхуіјѕԁһӏАВЕКМНОРСТХІЈЅοανιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcxyijsdhlABEKMHOPCTXIJSoaviABEZHIKMNOPTYX", strict=True))
DASHES = "‐‑‒–—―−"
INVISIBLE = "­​‌‍⁠﻿"
# The digits' names in English, German, French and Spanish.
NAMES = [
    "zero null zéro cero oh",
    "one eins un uno",
    "two zwei deux dos",
    "three drei trois tres",
    "four vier quatre cuatro",
    "five fünf cinq cinco",
    "six sechs seis",
    "seven sieben sept siete",
    "eight acht huit ocho",
    "nine neun neuf nueve",
]
# English names of two digits, and words that repeat the digit after them.
TEENS = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
REPEATS = {"double": "x2", "triple": "x3"}
AT, DOT, PLUS = ("at", "arroba", "chez"), ("dot", "punkt", "point", "punto"), ("plus", "más")
# Last labels that make a spelled-out address (without brackets) believable.
TOP_LABELS = frozenset("com org net edu gov mil int info biz io co us uk eu de fr es it nl ch at be pt mx ar cl test example invalid".split())
# All country labels, and general ones; with them an address needs a spelled dot.
MORE_LABELS = frozenset(
    """ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr
    cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie
    il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv
    mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr
    ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw
    academy agency app art asia auto bank bar berlin bike bio blog boston boutique build business cafe capital care cash cat center chat church city
    claims clinic cloud club coach codes coffee college community company computer consulting cool coop credit dance data date deals delivery dental design dev
    digital direct directory doctor dog domains download earth education email energy engineer engineering enterprises estate events exchange expert express
    family farm fashion finance financial fit foundation fun fund fyi gallery game games garden gent gift global gmbh google gratis green group guide guru hamburg
    haus health healthcare help holdings holiday homes hospital host hotel house immo inc industries ink institute insurance international investments jobs
    koeln kitchen land law lawyer legal life limited link live llc loan lol london love ltd ltda madrid management market marketing mba media medical men mobi
    moe money movie museum name network news nexus ngo ninja nyc one onl online ong page paris partners parts party pharmacy photo photography photos pics pictures
    pizza place plus post press pro productions properties pub quebec radio rent repair report republican restaurant reviews rocks run saarland sale salon sarl
    school schule science scot security services shop shopping show site ski social software solar solutions space sport store stream studio style supply support
    surf swiss systems tax taxi team tech technology tel tennis theater tickets tips tirol today tokyo tools top tours town toys trade training travel tube
    university vegas ventures versicherung vet video villas vip vision vote voyage wales wang watch web website wedding wien wiki win wine work works world wtf xxx
    xyz yoga zone localhost local onion""".split()
)
# Of those labels, the ones that are everyday words and may follow "at ... point"; and words that no spelled-out domain begins with.
LABEL_WORDS = frozenset("""ad ai al am as au ca ce do et ga il im in is je la li lu ma me mu my na ne ni no nu pa pm re sa se si so st su to tu va vu art bank bar care cash cat
    center city club date deals direct doctor dog energy events family farm finance fit fun fund game games garden gift green group guide health help home house
    land law legal life limited link live loan love management market media men money movie name network news one online page parts party place plus post press
    radio rent repair report run sale school science security show site social space sport store support tax team today tools top town trade training video
    vision vote watch web win work works world zone local""".split())
DETERMINERS = frozenset("""the this that these those a an any some every each which what no one my your his her its our their der die das dem den dieser diesem
    ein einem einer le la les ce cet cette un une quel tout el los las este ese aquel lui eux elle nous vous moi toi""".split())
# Words before an address, after which any last label is believed.
CUE = re.compile(r"(?<![a-z])(?:e-?mails?|mails?|contact|reach|write|address|kontakt|adresse|schreib\w*|correo|escrib\w*|courriel|contacter|écri\w*)(?![a-z])[^.!?\n]{0,40}$")
_bracketed = lambda words: rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{'|'.join(words)})\s{{0,3}}[\])}}>]\s{{0,3}}"
BRACKET_AT = re.compile(r"(?<=[a-z0-9])" + _bracketed((*AT, "@")) + r"(?=[a-z0-9])")
BRACKET_DOT = re.compile(r"(?<=[a-z0-9])" + _bracketed((*DOT, r"\.")) + r"(?=[a-z0-9])")
PLAIN = re.compile(rf"(?<![a-z0-9._%+-])[a-z0-9_%+-]++(?:\s+(?:{'|'.join(DOT)})\s+[a-z0-9_%+-]++|\.[a-z0-9_%+-]++)*(\s+(?:{'|'.join(AT)})\s+|@)[a-z0-9-]++((?:\s+(?:{'|'.join(DOT)})\s+|\.)[a-z0-9-]++)+")
PLAIN_DOT = re.compile(rf"\s+(?:{'|'.join(DOT)})\s+")
BRACKET_MARK = re.compile(r"[\[({<]\s{0,3}[@.]\s{0,3}[\])}>]")


def emails(t: str) -> list[Span]:
    out, floor, at = [], 0, t.find("@")
    while at >= 0:
        lo = at
        while lo > floor and t[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(t, at + 1) if lo < at else None
        if m:
            out.append(("email", lo, m.end()))
            floor = m.end()
        at = t.find("@", m.end() if m else at + 1)
    return out


def ips(t: str) -> list[Span]:
    out = []
    for m in CHAIN.finditer(t):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) < 3 or (len(p) == 3 and p <= "255") for x in four):
                out.append(("ip", at, at + size))
            at += size + 1
    return out


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(digits))) % 10 == 0


def cards(t: str) -> list[Span]:
    out = []
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out


def phones(t: str) -> list[Span]:
    return [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(DIGIT.findall(m[0])) <= 15] if "+" in t else []


def base_spans(t: str) -> list[Span]:
    """The plain identifiers of a text, by kind and then start."""
    out = emails(t)
    if DIGIT.search(t):
        out += ips(t) + cards(t) + phones(t)
    return out


@lru_cache(1)
def homoglyphs() -> dict[str, str]:
    """Each character that stands for an ASCII one (or for nothing), by rule: compatibility forms,
    decimal digits of any script, then the fixed look-alikes."""
    table = {}
    for k in [*range(0x80, 0x3400), *range(0xA000, 0xABFF), *range(0xFB00, 0x10000), *range(0x10000, 0x1FC00)]:
        c = chr(k)
        if (d := unicodedata.decimal(c, None)) is not None:
            table[c] = str(d)
        elif unicodedata.decomposition(c).startswith("<") and len(n := unicodedata.normalize("NFKC", c)) == 1 and n.isascii():
            table[c] = n
    return table | LOOKALIKES | dict.fromkeys(DASHES, "-") | dict.fromkeys(INVISIBLE, "")


@lru_cache(1)
def triggers():
    """An automaton of the words that a disguise needs, each with what it stands for: digits, a mark, or
    how often the next digit is meant."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for d, names in enumerate(NAMES):
        for w in names.split():
            a.add_word(w, (w, str(d)))
    for k, w in enumerate(TEENS):
        a.add_word(w, (w, str(10 + k)))
    for k, w in enumerate(TENS):
        a.add_word(w, (w, str(20 + 10 * k)))
    for words, mark in ((AT, "@"), (DOT, "."), (PLUS, "+")):
        for w in words:
            a.add_word(w, (w, mark))
    for w, mark in REPEATS.items():
        a.add_word(w, (w, mark))
    a.make_automaton()
    return a


class Tape:
    """A text under rewriting, with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.lo = np.arange(len(text))
        self.hi = self.lo + 1

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces text[start:end] for each edit (start, end, output), in order and apart; each
        output character stands for the whole source span that the edit consumed."""
        text, lo, hi, at = [], [], [], 0
        for start, end, output in edits:
            text += [self.text[at:start], output]
            lo += [self.lo[at:start], np.full(len(output), self.lo[start])]
            hi += [self.hi[at:start], np.full(len(output), self.hi[end - 1])]
            at = end
        self.text = "".join([*text, self.text[at:]])
        self.lo, self.hi = np.concatenate([*lo, self.lo[at:]]), np.concatenate([*hi, self.hi[at:]])


def lowered(t: str) -> str:
    low = t.lower()
    return low if len(low) == len(t) else "".join(x if len(x := c.lower()) == 1 else c for c in t)


def words_in(low: str) -> list[tuple[int, int, str]]:
    """The trigger words that stand alone, longest first where two begin together."""
    found: dict[int, tuple[int, int, str]] = {}
    for last, (w, mark) in triggers().iter(low):
        lo, hi = last + 1 - len(w), last + 1
        if not (lo and low[lo - 1].isalnum()) and not low[hi : hi + 1].isalnum():
            found[lo] = (lo, hi, mark)
    return [found[k] for k in sorted(found)]


def digit_edits(low: str, words: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Transducer of spelled digits. Three names at least that follow each other, apart by spaces,
    commas, dashes or written digits, become one digit string; a spelled dot or plus between or
    before them becomes its mark. "Twenty five" is 25, "double five" is 55."""
    edits, run = [], []
    gap = re.compile(r"[\s,;_/-]*+(?:[0-9][\s,;_/-]*+)*+")

    def composed() -> list[tuple[int, int, str]]:
        """The run with pairs of words that make one number put together."""
        out, k = [], 0
        while k < len(run):
            (lo, hi, mark), after = run[k], run[k + 1] if k + 1 < len(run) else None
            unit = after[2] if after and len(after[2]) == 1 and after[2].isdigit() and not low[hi : after[0]].strip(" -") else ""
            if mark[0] == "x":
                if unit:
                    out.append((lo, after[1], unit * int(mark[1])))
                    k += 1
            elif len(mark) == 2 and mark[1] == "0" and mark[0] > "1" and unit not in ("", "0"):
                out.append((lo, after[1], mark[0] + unit))
                k += 1
            else:
                out.append((lo, hi, mark))
            k += 1
        return out

    def close() -> None:
        while run and run[-1][2] == ".":
            run.pop()
        if sum(x[2].isdigit() for x in run) >= 3:
            numbers = composed()
            for (lo, hi, mark), after in zip(numbers, [*numbers[1:], None], strict=True):
                if after is None:
                    edits.append((lo, hi, mark))
                else:
                    edits.append((lo, after[0], mark + "".join(DIGIT.findall(low, hi, after[0]))))
        run.clear()

    for w in words:
        if w[2] == "@":
            continue
        if run and not ((m := gap.match(low, run[-1][1])) and m.end() == w[0] and w[2] != "+"):
            close()
        if run or w[2] != ".":
            run.append(w)
    close()
    return edits


def believable(m: re.Match) -> bool:
    """Whether a match of PLAIN is an address: by its last label, and for labels beyond TOP_LABELS by
    a spelled dot and words that hardly stand in a sentence like "at this point in". After a word like
    "contact" any label of letters will do that is no everyday word."""
    at = m.end(1) - m.start()
    dots, domain = PLAIN_DOT.findall(m[0], at), re.split(r"[\s.]+", m[0][at:])
    last = domain[-1]
    if last in TOP_LABELS:
        return bool(dots) or m[1] == "@"
    if not dots or m[1] != "@" and domain[0] in DETERMINERS:
        return False
    if last.startswith("xn--") or last in MORE_LABELS and (dots[-1].strip() == "dot" or last not in LABEL_WORDS):
        return True
    cued = CUE.search(m.string, max(0, m.start() - 60), m.start())
    return bool(cued) and dots[-1].strip() == "dot" and last.isalpha() and 2 <= len(last) <= 24 and last not in LABEL_WORDS


def address_edits(low: str) -> list[tuple[int, int, str]]:
    """Transducer of at and dot: in brackets anywhere between letters or digits; in plain words only
    where both are spelled, or the dot alone, and the last label is a known one."""
    edits = [(*m.span(), "@") for m in BRACKET_AT.finditer(low)] + [(*m.span(), ".") for m in BRACKET_DOT.finditer(low)]
    for m in PLAIN.finditer(low):
        if believable(m):
            edits += [(*m.span(1), "@")] if m[1] != "@" else []
            edits += [(m.start() + x.start(), m.start() + x.end(), ".") for x in PLAIN_DOT.finditer(m[0])]
    out = []
    for e in sorted(edits):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def disguised_spans(t: str, base: list[Span]) -> list[Span]:
    """Identifiers that show only after normalisation: all but those within a base span of their kind."""
    tape, changed = Tape.__new__(Tape), False
    tape.text = t
    if not t.isascii():
        table = homoglyphs()
        if not table.keys().isdisjoint(t):
            tape = Tape(t)
            tape.rewrite([(i, i + 1, table[c]) for i, c in enumerate(t) if c in table])
            changed = True
    low = lowered(tape.text)
    words = words_in(low)
    marks = {w[2] for w in words}
    spelled = sum(w[2].isdigit() for w in words) >= 3
    hidden = "." in marks or any(w[2] == "@" and low[max(0, w[0] - 4) : w[0]].rstrip()[-1:] in tuple("[({<") for w in words) or bool(BRACKET_MARK.search(low))
    if not changed and not spelled and not hidden:
        return []
    if not changed:
        tape = Tape(t)
    if spelled and (edits := digit_edits(low, words)):
        tape.rewrite(edits)
        changed, low = True, lowered(tape.text)
    if hidden and (edits := address_edits(low)):
        tape.rewrite(edits)
        changed = True
    if not changed:
        return []
    taken = {kind: sorted((a, b) for k, a, b in base if k == kind) for kind in KINDS}
    out = []
    for kind, a, b in base_spans(tape.text):
        lo, hi = int(tape.lo[a]), int(tape.hi[b - 1])
        i = bisect_right(taken[kind], (lo, len(t)))  # spans of a kind lie apart, so the last one that begins by lo decides
        if not (i and hi <= taken[kind][i - 1][1]):
            out.append((kind, lo, hi))
    return out


def find(t: str) -> tuple[list[Span], list[Span]]:
    """The base spans of a text, and the ones that normalisation adds."""
    base = base_spans(t)
    return base, disguised_spans(t, base)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_email, n_ip, n_card, n_phone (of the base spans), base_sha256, spans (base
    and added, `kind:start:end` in code points, by kind and start) and n_added.

    Null counts as an empty text: no spans, the hash of the empty string. Repeated rows each give a
    row; a null id stays null.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [f"n_{k}" for k in KINDS]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {k: i for i, k in enumerate(KINDS)}
        for b in packs(batches, "_t"):
            found = [find(t) for t in texts_of(b, "_t")]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            every = [joined(sorted(base + more, key=lambda s: (rank[s[0]], s[1]))) for base, more in found]
            yield pa.RecordBatch.from_arrays([col(b, "_k"), *counts, pa.array(sha), pa.array(every), pa.array([len(m) for _, m in found], pa.int64())], [id_col, *names, "base_sha256", "spans", "n_added"])

    schema = f"`{id_col}` {id_type}, {', '.join(f'{n} long' for n in names)}, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(id_col).alias("_k"), F.col(text_col).alias("_t")).mapInArrow(run, schema)


def mask(t: str) -> str:
    """The text with each span, or chain of overlapping spans, replaced by its first kind in angle brackets."""
    base, more = find(t)
    spans = sorted(((a, b, k) for k, a, b in base + more), key=lambda s: (s[0], -s[1]))
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [t[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join([*out, t[at:]]) if spans else t


def mask_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with the identifiers of each text masked; its length in code points is set anew. Null stays null."""
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in packs(batches, text_col):
            texts = [None if t is None else mask(t) for t in b.column(schema.names.index(text_col)).to_pylist()]
            arrays = list(b.columns)
            arrays[schema.names.index(text_col)] = pa.array(texts, pa.string())
            if length_col in schema.names:
                at = schema.names.index(length_col)
                arrays[at] = pa.array([None if t is None else len(t) for t in texts], arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.mapInArrow(run, schema)
