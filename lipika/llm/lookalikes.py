"""Problem 4: one form for texts that look the same.

Look-alike pairs of strings and code points are closed transitively by
union-find into classes. Each class is represented by the member that the
corpus uses most. Texts are rewritten by a multi-pattern automaton, greedily
and longest match first, after invisible characters are dropped and marks are
decomposed.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipika.session import pick, written

# Code points without a glyph of their own (default ignorable ones), as ranges.
INVISIBLE_RANGES = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF),
)

# Letters of other scripts drawn like the Latin letter in front.
CROSS_SCRIPT = """
A Α А Ꭺ; B Β В Ᏼ; C С Ϲ Ꮯ; D Ꭰ; E Ε Е Ꭼ; F Ϝ; G Ꮐ Ԍ; H Η Н Ꮋ; I Ι І Ӏ; J Ј Ϳ Ꭻ; K Κ К Ꮶ; L Ꮮ; M Μ М Ϻ Ꮇ; N Ν; O Ο О Օ; P Ρ Р Ꮲ;
Q Ԛ; S Ѕ Տ Ꮪ; T Τ Т Ꭲ; U Ս; V Ѵ Ꮩ; W Ԝ Ꮃ; X Χ Х; Y Υ Ү; Z Ζ Ꮓ; a а; c с ϲ; d ԁ; e е; g ց; h һ հ; i і; j ј ϳ; l ӏ; n ո; o ο о օ;
p р; q ԛ; s ѕ; u ս; v ν ѵ; w ԝ; x х; y у ү; æ ӕ; ə ә
"""
# Letters, and letters written as sequences, drawn alike within or between the other scripts.
DRAWN_ALIKE = """
अा आ; अो अाे आे ओ; अौ अाै आै औ; अॉ अाॅ आॅ ऑ; अॊ अाॆ आॆ ऒ; अॅ ॲ; अॆ ऄ; एे ऐ; एॅ ऍ; एॆ ऎ; ाे ो; ाै ौ; ाॅ ॉ; ाॆ ॊ; । |; ॥ ।। ||;
অা আ; ঋৃ ৠ; ঌৢ ৡ; অ্যা অ্যা; અા આ; અે એ; અૈ ઐ; અૅ ઍ; અૉ અાૅ આૅ ઑ; અો અાે આે ઓ; અૌ અાૈ આૈ ઔ; ાે ો; ાૈ ૌ; ાૅ ૉ;
ਅਾ ਆ; ੲਿ ਇ; ੲੀ ਈ; ੳੁ ਉ; ੳੂ ਊ; ੲੇ ਏ; ਅੈ ਐ; ਅੌ ਔ; ଅା ଆ; ஒள ஔ; ௗ ள; ఒౌ ఔ; ಒೌ ಔ; เเ แ; ํา ำ; ໍາ ຳ;
ک ك; ی ى; ہ ه; ٠ ۰; ١ ۱; ٢ ۲; ٣ ۳; ٧ ۷; ٨ ۸; ٩ ۹; へ ヘ; べ ベ; ぺ ペ; 二 ニ; 八 ハ; 力 カ; 口 ロ; 夕 タ; 工 エ; 卜 ト; - ‐ ‑
"""
# Telugu letters, signs and digits drawn like the Kannada ones 0x80 further on; Myanmar and Oriya letters like digits.
LIKE_KANNADA = "ంఃఅఆఇఒఓఔజఞణయఱల౧౨౯"
LIKE_DIGITS = "ဝ ၀; ၎ ၄; ଠ ୦"
#: Decompositions of these kinds look like what they decompose to; circled, raised, small and bold ones do not.
SAME_KINDS = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Blocks in which decompositions of kind <compat> look the same: ligatures, Roman numerals, radicals, digraphs.
SAME_BLOCKS = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x0E33, 0x0E33), (0x0EB3, 0x0EB3), (0x2160, 0x217F), (0x2F00, 0x2FD5), (0xFB00, 0xFB06), (0xFB13, 0xFB17))
#: Texts of one writing that meet those of another in one task.
CELL = 20_000
#: A corpus can only shift which member of a class represents it, so counts are kept for members of classes alone.
_COUNTS = "member string, n long"


INVISIBLE = re.compile("[" + "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in INVISIBLE_RANGES) + "]")


def _listed(text: str) -> Iterator[tuple[str, str]]:
    for entry in text.replace("\n", " ").split(";"):
        first, *others = entry.split()
        yield from ((first, x) for x in others)


def _decomposed() -> Iterator[tuple[str, str]]:
    for c in range(0x110000):
        kind, _, rest = (d := unicodedata.decomposition(chr(c))).partition(" ")
        if d.startswith("<") and (kind in SAME_KINDS or kind == "<compat>" and any(lo <= c <= hi for lo, hi in SAME_BLOCKS)):
            yield chr(c), "".join(chr(int(x, 16)) for x in rest.split())


def pairs() -> Iterator[tuple[str, str]]:
    """All pairs of strings that look the same, canonical equivalence aside."""
    yield from _listed(CROSS_SCRIPT)
    yield from _listed(DRAWN_ALIKE)
    yield from _listed(LIKE_DIGITS)
    yield from ((c, chr(ord(c) + 0x80)) for c in LIKE_KANNADA)
    yield from _decomposed()


def classes(links: Iterable[tuple[str, str]] | None = None) -> list[list[str]]:
    """Transitive look-alike classes of the decomposed strings, by union-find; each sorted, shortest first."""
    up: dict[str, str] = {}

    def find(x: str) -> str:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs() if links is None else links:
        a, b = find(unicodedata.normalize("NFD", a)), find(unicodedata.normalize("NFD", b))
        if a != b and a and b:
            up[b] = a
    out: dict[str, list[str]] = {}
    for x in up:
        out.setdefault(find(x), []).append(x)
    return sorted(sorted(c, key=lambda s: (len(s), s)) for c in out.values() if len(c) > 1)


_KEPT: dict[str, object] = {}


def _members() -> tuple[list[list[str]], ahocorasick.Automaton]:
    if "members" not in _KEPT:
        found, auto = classes(), ahocorasick.Automaton()
        for c in found:
            for m in c:
                if len(m) > 1:
                    auto.add_word(m, (len(m), m))
        auto.make_automaton()
        _KEPT["members"] = (found, auto)
    return _KEPT["members"]


def _single() -> set[str]:
    """Members that are single letters."""
    if "single" not in _KEPT:
        _KEPT["single"] = {m for c in _members()[0] for m in c if len(m) == 1}
    return _KEPT["single"]


def decomposed(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFD", text)


def bare(text: str) -> str:
    """Without invisible characters, and with marks decomposed in canonical order."""
    return decomposed(text if text.isascii() else INVISIBLE.sub("", text))


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """member -> representative: the most used member, then one that isn't a compatibility form, the shortest, the smallest.

    A representative of several letters is itself written in the
    representatives of its letters, so that a class of sequences agrees with
    the classes of single letters.
    """
    best = {m: min(c, key=lambda x: (-counts.get(x, 0), x != unicodedata.normalize("NFKD", x), len(x), x)) for c in _members()[0] for m in c}
    single = {ord(m): r for m, r in best.items() if len(m) == 1 and len(r) == 1 and m != r}
    return {m: to for m, r in best.items() if (to := r.translate(single) if len(r) > 1 else r) != m}


def _greedy(auto: ahocorasick.Automaton, text: str) -> Iterator[tuple[int, int, str]]:
    """(start, length, value) of matches from the left, the longest at each place, none overlapping.

    The automaton reports every match in one pass; the few there are get sorted.
    """
    found = sorted((end + 1 - v[0], -v[0], v[1]) for end, v in auto.iter(text))
    at = 0
    for start, n, to in found:
        if start >= at:
            yield start, -n, to
            at = start - n


def used_members(counts: dict[str, int]) -> list[str]:
    """Members that a text of this corpus can need: those that occur, and the sequences of their classes."""
    return sorted(m for c in _members()[0] if any(counts.get(m, 0) for m in c) for m in c if len(m) > 1 or counts.get(m, 0))


def rewriter(rep: dict[str, str], used: list[str] | None = None) -> Callable[[str], str]:
    """The function that brings a text to its one form; it keeps what it has already brought there.

    Single letters that represent themselves need no match; sequences do, since
    they keep their parts from being rewritten. ``used`` limits the automaton
    to what the corpus holds, which keeps its root narrow.
    """
    auto = ahocorasick.Automaton()
    for m in [m for c in _members()[0] for m in c] if used is None else used:
        if m in rep or len(m) > 1:
            auto.add_word(m, (len(m), rep.get(m, m)))
    if not len(auto):
        auto.add_word("\x00\x00", (2, "\x00\x00"))
    auto.make_automaton()

    def once(text: str) -> str:
        out, at = [], 0
        for start, n, to in _greedy(auto, text):
            out += (text[at:start], to)
            at = start + n
        return "".join((*out, text[at:])) if out else text

    def rewrite(text: str) -> str:
        text = bare(text)
        for _ in range(4):  # a representative may complete another member with its neighbour
            made = once(text)
            if made is text:
                break
            text, before = decomposed(made), text
            if text == before:
                break
        return text if text.isascii() else unicodedata.normalize("NFC", text)

    return rewrite


def member_counts(texts: DataFrame, column: str = "text") -> dict[str, int]:
    """How often each member of a class occurs in all texts: partial counts by task, summed; bounded by the classes.

    Letters are counted wherever they stand, sequences by longest match.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, auto = _members()
        n: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    text = bare(t)
                    n.update(text)
                    n.update(m for _, _, m in _greedy(auto, text))
        kept = {m: k for m, k in n.items() if len(m) > 1 or m in _single()}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["member", "n"])

    found = texts.select(column).mapInArrow(count, _COUNTS).groupBy("member").agg(F.sum("n").alias("n"))
    return {r.member: r.n for r in found.collect()}


def canonical(texts: DataFrame, columns: list[str], rep: dict[str, str], used: list[str] | None = None) -> DataFrame:
    """``texts`` with ``canon_<column>`` for each of ``columns``; null stays null, empty stays empty."""

    def one(name: str):
        @F.pandas_udf("string")
        def form(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            rewrite = rewriter(rep, used)
            for s in parts:
                yield s.map(lambda t: rewrite(t) if t is not None else None)

        return form(F.col(name))

    return texts.withColumns({f"canon_{c}": one(c) for c in columns})


def corpus_form(probe: DataFrame, pages: DataFrame) -> tuple[dict[str, str], list[str]]:
    """Representatives, and members in use, by frequency over both texts of the probe and the pages' text."""
    texts = probe.select(F.col("ground_truth").alias("text")).unionByName(probe.select(F.col("sarvam_text").alias("text"))).unionByName(pages.select("text"))
    counts = member_counts(texts)
    return representatives(counts), used_members(counts)


def members(texts: DataFrame, key: str, column: str, rep: dict[str, str], used: list[str] | None = None) -> DataFrame:
    """(``key``, form, writing): the class of every text and its own writing, both as digests; written, so that each text is rewritten once.

    Null texts are in no class.
    """
    forms = canonical(pick(texts, key, column).where(F.col(column).isNotNull()), [column], rep, used)
    return written(forms.select(key, F.sha2(f"canon_{column}", 256).alias("form"), F.sha2(column, 256).alias("writing")), "members")


def look_classes(found: DataFrame) -> DataFrame:
    """(form, texts, writings): one row a class of :func:`members`, with how many texts and different writings it has."""
    each = found.groupBy("form", "writing").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("form").agg(F.sum("n").alias("texts"), F.count(F.lit(1)).alias("writings"))


def pairs_within(found: DataFrame, key: str) -> DataFrame:
    """(id_a, id_b): all pairs of texts of one class in different writings, the smaller id first.

    Only classes with several writings take part. Pairs of writings are formed
    first; the texts of a writing that many share are dealt to cells, each of
    them at most about :data:`CELL` texts by as many.
    """
    each = found.groupBy("form", "writing").agg(F.count(F.lit(1)).alias("n"))
    several = written(each.join(look_classes(found).where("writings > 1").select("form"), "form", "left_semi"), "writings")
    most = several.agg(F.max("n")).first()[0] or 0
    cells = max(1, -(-most // CELL))
    lo, hi = (several.select("form", F.col("writing").alias(w)) for w in ("w_lo", "w_hi"))
    both = lo.join(hi, "form").where("w_lo < w_hi").select("w_lo", "w_hi")
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(cells)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    a = found.select(F.col(key).alias("x"), F.col("writing").alias("w_lo"), deal(key).alias("row")).join(both, "w_lo").withColumn("col", every)
    b = found.select(F.col(key).alias("y"), F.col("writing").alias("w_hi"), deal(key).alias("col")).join(several.select(F.col("writing").alias("w_hi")), "w_hi", "left_semi").withColumn("row", every)
    return a.join(b, ["w_hi", "row", "col"]).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def same_looking(probe: DataFrame, pages: DataFrame) -> DataFrame:
    """(record_kind, id_a, id_b): texts that aren't equal but look the same.

    Probe rows: ground truth against the text read. Pages: any two rows. Null
    texts are no case; empty texts are equal. :func:`members` and
    :func:`look_classes` tell the same of pages without forming pairs.
    """
    probe, pages = pick(probe, "probe_id", "ground_truth", "sarvam_text"), pick(pages, "page_id", "text")
    rep, used = corpus_form(probe, pages)
    calls = canonical(probe.where("ground_truth <> sarvam_text"), ["ground_truth", "sarvam_text"], rep, used)
    of_probe = calls.where("canon_ground_truth = canon_sarvam_text").select(F.lit("probe").alias("record_kind"), F.col("probe_id").alias("id_a"), F.col("probe_id").alias("id_b"))
    of_pages = pairs_within(members(pages, "page_id", "text", rep, used), "page_id").select(F.lit("page").alias("record_kind"), "id_a", "id_b")
    return of_probe.unionByName(of_pages)


def normalised(probe: DataFrame, pages: DataFrame) -> DataFrame:
    """(record_kind, record_id, field, text): every text in its one form."""
    probe, pages = pick(probe, "probe_id", "ground_truth", "sarvam_text"), pick(pages, "page_id", "text")
    rep, used = corpus_form(probe, pages)
    p = canonical(probe.select("probe_id", "ground_truth", "sarvam_text"), ["ground_truth", "sarvam_text"], rep, used)
    g = canonical(pages.select("page_id", "text"), ["text"], rep, used)
    rows = [(p, "probe", "probe_id", "ground_truth"), (p, "probe", "probe_id", "sarvam_text"), (g, "page", "page_id", "text")]
    made = [d.select(F.lit(kind).alias("record_kind"), F.col(i).alias("record_id"), F.lit(f).alias("field"), F.col(f"canon_{f}").alias("text")) for d, kind, i, f in rows]
    return made[0].unionByName(made[1]).unionByName(made[2])
