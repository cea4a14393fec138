"""Text scalars (H1-H19) as column expressions; Python only where the JVM has no counterpart."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from lipika.functions.arrays import let

# Consonants that take part in conjuncts, their virama, and extending marks, by Unicode 15.1 rule GB9c.
CONSONANTS = (
    r"\u0915-\u0939\u0958-\u095f\u0978-\u097f\u0995-\u09a8\u09aa-\u09b0\u09b2\u09b6-\u09b9\u09dc\u09dd\u09df\u09f0\u09f1"
    r"\u0a95-\u0aa8\u0aaa-\u0ab0\u0ab2\u0ab3\u0ab5-\u0ab9\u0af9\u0b15-\u0b28\u0b2a-\u0b30\u0b32\u0b33\u0b35-\u0b39\u0b5c\u0b5d\u0b5f\u0b71"
    r"\u0c15-\u0c28\u0c2a-\u0c39\u0c58-\u0c5a\u0d15-\u0d3a"
)
VIRAMAS = r"\u094d\u09cd\u0acd\u0b4d\u0c4d\u0d4d"
EXTENDING = r"\p{Mn}\u200d\u09be\u09d7\u0b3e\u0b57\u0d3e\u0d57"
CLUSTER = rf"(?:[{CONSONANTS}][{EXTENDING}]*[{VIRAMAS}][{EXTENDING}]*(?=[{CONSONANTS}]))*\X"
# What no mark joins, and what joins the character before, for regular expressions without \X and look-ahead.
ALONE = r"\p{Cc}\p{Zl}\p{Zp}\x{ad}\x{61c}\x{180e}\x{200b}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}"
JOINING = r"\p{M}\x{200c}\x{200d}\x{e33}\x{eb3}\x{ff9e}\x{ff9f}"
# Indic and Arabic blocks whose clusters count as glyphs.
GLYPH_BLOCKS = r"[\u0900-\u097f\u0980-\u09ff\u0a00-\u0a7f\u0a80-\u0aff\u0b00-\u0b7f\u0b80-\u0bff\u0600-\u06ff\u0750-\u077f\u1c50-\u1c7f]"
# Nasal, and first and last consonant of its class.
NASALS = {"\u0919": ("\u0915", "\u0919"), "\u091e": ("\u091a", "\u091e"), "\u0923": ("\u091f", "\u0923"), "\u0928": ("\u0924", "\u0928"), "\u092e": ("\u092a", "\u092e")}
# What counts as white space, as a class for both engines.
BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Writings that count as one reading, longest first.
SAME_READING = {
    "\u09a4\u09cd\u200d": "\u09ce", "||": "..",
    "\u094d\u200d": "\u094d", "\u094d\u200c": "\u094d", "\u09cd\u200d": "\u09cd", "\u09cd\u200c": "\u09cd",
    "\u0915\u093c": "\u0958", "\u0916\u093c": "\u0959", "\u0917\u093c": "\u095a", "\u091c\u093c": "\u095b", "\u0921\u093c": "\u095c", "\u0922\u093c": "\u095d", "\u092b\u093c": "\u095e",
    "\u09a1\u09bc": "\u09dc", "\u09a2\u09bc": "\u09dd", "\u09af\u09bc": "\u09df", "\u0965": "..",
}
JOINERS, NUKTAS = "\u200d\u200c", "\u093c\u09bc"
SINGLE_FROM = "\u0964|" + "".join(chr(z + d) for z in (0x0966, 0x09E6) for d in range(10))
SINGLE_TO = ".." + "0123456789" * 2
# ISO 15919 letters in the order of the Devanagari block: vowels from U+0905, consonants from U+0915, vowel signs from U+093E, letters with nukta from U+0958.
ISO_VOWELS = "a \u0101 i \u012b u \u016b r\u0325 l\u0325 \u00ea e \u0113 ai \u00f4 o \u014d au".split()
ISO_CONSONANTS = "k kh g gh \u1e45 c ch j jh \u00f1 \u1e6d \u1e6dh \u1e0d \u1e0dh \u1e47 t th d dh n \u1e49 p ph b bh m y r \u1e5f l \u1e37 \u1e3b v \u015b \u1e63 s h".split()
ISO_SIGNS = "\u0101 i \u012b u \u016b r\u0325 r\u0325\u0304 \u00ea e \u0113 ai \u00f4 o \u014d au".split()
ISO_NUKTA = "q k\u035fh \u0121 z \u1e5b \u1e5bh f \u1e8f".split()
ISO_OTHERS = {"\u0901": "m\u0310", "\u0902": "\u1e41", "\u0903": "\u1e25", "\u093d": "\u2019", "\u0950": "\u014d\u1e41", "\u0960": "r\u0325\u0304", "\u0961": "l\u0325\u0304", "\u0964": ".", "\u0965": ".."}
# Languages written in a script that ISO 15919 transliterates, and where its block lies from the Devanagari one.
ISO_LANGUAGES = {"hindi": 0, "bengali": 0x80}


def graphemes(c: Column) -> Column:
    """Extended grapheme clusters, Indic conjuncts whole; null for null, [] for an empty text."""
    return F.regexp_extract_all(c, F.lit(CLUSTER), F.lit(0))


def glyph_clusters(c: Column) -> Column:
    """Clusters with a letter of an Indic or Arabic block."""
    return F.filter(graphemes(c), lambda g: g.rlike(GLYPH_BLOCKS) & (F.trim(g) != ""))


def whitespace(c: Column) -> Column:
    """Runs of Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{BLANKS}+", " "))


def anusvara(c: Column) -> Column:
    """Nasal and virama before a consonant of the nasal's class as anusvara; before the nasal itself last."""
    before = lambda of: "|".join(f"{nasal}\u094d(?=[{of(first, last)}])" for nasal, (first, last) in NASALS.items())
    c = F.regexp_replace(c, before(lambda first, last: f"{first}-{chr(ord(last) - 1)}"), "\u0902")
    return F.regexp_replace(c, before(lambda first, last: last), "\u0902")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition, which the JVM side does not offer."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def _nasals(of: Callable[[str, str], str]) -> re.Pattern:
    return re.compile("|".join(f"{nasal}\u094d(?=[{of(first, last)}])" for nasal, (first, last) in NASALS.items()))


_NASAL_BEFORE = (_nasals(lambda first, last: f"{first}-{chr(ord(last) - 1)}"), _nasals(lambda first, last: last))
_JOINED = re.compile("([\u094d\u09cd])(?:\u200d\u200c?|\u200c)")
_STOP = re.compile(r" +(\.+)")
_SINGLE = str.maketrans(SINGLE_FROM, SINGLE_TO)


def tier1_form(t: str) -> str:
    """The form of one text in which encoding variants are equal.

    Order matters: composition, white space, nasals, variants from the longest
    on, blanks before stops.
    """
    if not t.isascii():
        t = unicodedata.normalize("NFC", t)
    t = " ".join(t.split())
    if not t.isascii():
        if "\u094d" in t:
            for pattern in _NASAL_BEFORE:
                t = pattern.sub("\u0902", t)
        for variant, to in SAME_READING.items():
            if variant[-1] not in JOINERS or len(variant) > 2:
                t = t.replace(variant, to)
            elif variant in t:
                t = _JOINED.sub(r"\1", t)
    else:
        t = t.replace("||", "..")
    return _STOP.sub(r"\1", t.translate(_SINGLE))


def _each(f: Callable, s: Iterable) -> list:
    """``f`` of each value, once for repeated ones; null for null."""
    known: dict = {None: None}
    return [known[t] if t in known else known.setdefault(t, f(t)) for t in s]


@F.pandas_udf(StringType())
def tier1(s: pd.Series) -> pd.Series:
    """:func:`tier1_form` of a column. Composition has no counterpart in the JVM, so the whole form is made in that one Arrow batch."""
    return pd.Series(_each(tier1_form, s), dtype="object")


#: Cells of edit distance tables held at once.
CELLS = 400_000


def _differing(a: Sequence[str], b: Sequence[str]) -> tuple[Sequence[str], Sequence[str]]:
    """What lies between the common beginning and the common end of two sequences."""
    most = min(len(a), len(b))
    s = next((k for k in range(most) if a[k] != b[k]), most)
    e = next((k for k in range(most - s) if a[-1 - k] != b[-1 - k]), most - s)
    return a[s : len(a) - e], b[s : len(b) - e]


def distances(a: Sequence[Sequence[str]], b: Sequence[Sequence[str]]) -> np.ndarray:
    """Edit distance of each pair of sequences, many of like lengths in lockstep, a row of their tables at a time."""
    a, b = zip(*map(_differing, a, b)) if len(a) else ((), ())
    out = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int32)
    todo = sorted((k for k in range(len(out)) if len(a[k]) and len(b[k])), key=lambda k: (len(a[k]), len(b[k])))
    code: dict[str, int] = {}
    s = 0
    while s < len(todo):
        n = m = 0
        e = s
        while e < len(todo):
            n2, m2 = max(n, len(a[todo[e]])), max(m, len(b[todo[e]]))
            if e > s and (e + 1 - s) * (n2 + m2 + 2) > CELLS:
                break
            n, m, e = n2, m2, e + 1
        mine = todo[s:e]
        s = e
        x, y = np.full((len(mine), n), -1, np.int32), np.full((len(mine), m), -2, np.int32)
        for r, k in enumerate(mine):
            x[r, : len(a[k])] = [code.setdefault(c, len(code)) for c in a[k]]
            y[r, : len(b[k])] = [code.setdefault(c, len(code)) for c in b[k]]
        step = np.arange(m + 1, dtype=np.int32)
        row, ends = np.repeat(step[None], len(mine), 0), np.array([len(a[k]) for k in mine])
        at = np.array([len(b[k]) for k in mine])
        for i in range(1, n + 1):
            best = row + 1
            np.minimum(best[:, 1:], row[:, :-1] + (y != x[:, i - 1, None]), out=best[:, 1:])
            row = np.minimum.accumulate(best - step, axis=1) + step
            done = np.flatnonzero(ends == i)
            out[np.array(mine)[done]] = row[done, at[done]]
    return out


@F.pandas_udf(IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(np.full(len(a), None), dtype="object")
    out[known] = distances(a[known].tolist(), b[known].tolist())
    return out


@F.pandas_udf(StructType([StructField(c, IntegerType()) for c in ("n_gt", "n_hyp", "dist")]))
def measured(gt: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Clusters of both texts and their edit distance, in one batch; null where a text is."""
    import regex

    a, b = (_each(regex.compile(r"\X").findall, s) for s in (gt, hyp))
    both = [k for k in range(len(a)) if a[k] is not None and b[k] is not None]
    dist = pd.Series([None] * len(a), dtype="object")
    dist.iloc[both] = distances([a[k] for k in both], [b[k] for k in both]).tolist()
    size = lambda c: pd.Series([None if x is None else len(x) for x in c], dtype="object")
    return pd.DataFrame({"n_gt": size(a), "n_hyp": size(b), "dist": dist})


@F.pandas_udf(DoubleType())
def covered(gt: pd.Series, hyp: pd.Series) -> pd.Series:
    """Share of the truth's clusters, counted with multiplicity, that the reading has; an empty truth is covered, null texts give null."""
    import regex

    a, b = (_each(lambda t: Counter(regex.findall(r"\X", t)), s) for s in (gt, hyp))
    return pd.Series([None if x is None or y is None else (x & y).total() / x.total() if x else 1.0 for x, y in zip(a, b)], dtype="float64")


def cluster_distance(a: Column, b: Column) -> Column:
    """Edit distance between two arrays of clusters; null where one is."""
    return _distance(a, b)


def _iso(text: str, language: str) -> str:
    shift, out, open_a, vowel = ISO_LANGUAGES[language], [], False, False
    text = unicodedata.normalize("NFC", text).replace("\u09ce", "\u09a4\u09cd")
    for ch in text:
        if ch in JOINERS:
            continue
        c = ord(ch) - shift if shift and 0x980 <= ord(ch) <= 0x9FF else ord(ch)
        base = chr(c)
        if base == "\u093c":  # nukta: the letter before becomes another one
            k = "\u0915\u0916\u0917\u091c\u0921\u0922\u092b\u092f".find(chr(last)) if open_a else -1
            if k >= 0:
                out[-1] = ISO_NUKTA[k]
            continue
        if open_a and not (base == "\u094d" or 0x93E <= c <= 0x94C):
            out.append("a")
            vowel = True
        if 0x905 <= c <= 0x914:
            out.append((":" if vowel else "") + ISO_VOWELS[c - 0x905])
            open_a, vowel = False, True
        elif 0x915 <= c <= 0x939 or 0x958 <= c <= 0x95F:
            out.append(ISO_CONSONANTS[c - 0x915] if c <= 0x939 else ISO_NUKTA[c - 0x958])
            open_a, vowel, last = True, False, c
        elif 0x93E <= c <= 0x94C:
            out.append(ISO_SIGNS[c - 0x93E])
            open_a, vowel = False, True
        elif base == "\u094d":
            open_a, vowel = False, False
        else:
            out.append(chr(c - 0x966 + 48) if 0x966 <= c <= 0x96F else ISO_OTHERS.get(base, base))
            open_a, vowel = False, False
    return "".join(out) + ("a" if open_a else "")


@F.pandas_udf(StringType())
def iso15919(s: pd.Series, language: pd.Series) -> pd.Series:
    """The ISO 15919 transliteration of texts in Hindi and Bengali; null for other languages."""
    return pd.Series(_each(lambda x: _iso(*x), [(t, lang) if t is not None and lang in ISO_LANGUAGES else None for t, lang in zip(s, language)]), dtype="object")


_SIGNS = {chr(v + 0x94D) + chr(v + 0x905 + k): chr(v + 0x93E + ISO_SIGNS.index(x)) if x in ISO_SIGNS else "" for v in ISO_LANGUAGES.values() for k, x in enumerate(ISO_VOWELS) if x == "a" or x in ISO_SIGNS}
_SIGN = re.compile("|".join(_SIGNS))
_SOUND = str.maketrans({**dict.fromkeys(JOINERS), "\u09ce": "\u09a4\u09cd", "\u0950": "\u0913\u0902", "\u0964": ".", "\u0965": "..", **{chr(z + d): str(d) for z in (0x966, 0x9E6) for d in range(10)}})


def sound_form(t: str) -> str:
    """A form that is equal where transliterations are: composed, joiners gone, one writing of each letter, a vowel behind a virama as its sign."""
    return _SIGN.sub(lambda m: _SIGNS[m.group()], unicodedata.normalize("NFC", t).translate(_SOUND))


@F.pandas_udf(StringType())
def sound(s: pd.Series, language: pd.Series) -> pd.Series:
    """:func:`sound_form` of texts in a language that is transliterated; null for others."""
    form = _each(sound_form, s)
    return pd.Series([x if lang in ISO_LANGUAGES else None for x, lang in zip(form, language)], dtype="object")


def tier2(gt: Column, hyp: Column, language: Column) -> Column:
    """Whether two texts sound the same: equal transliterations, told by :func:`sound`; false outside the languages that have one."""
    return F.coalesce(sound(gt, language) == sound(hyp, language), F.lit(False))


def error_rate(distance: Column, gt_len: Column, hyp_len: Column, empty: str = "inf") -> Column:
    """Distance over length; for an empty truth 0 against nothing, else infinite (``inf``) or 1 (``one``)."""
    worst = F.lit(float("inf")) if empty == "inf" else F.lit(1.0)
    return F.when(gt_len == 0, F.when(hyp_len == 0, F.lit(0.0)).otherwise(worst)).otherwise(distance / F.nullif(gt_len, F.lit(0)))


def finite(rate: Column) -> Column:
    """Infinite and NaN rates as 1."""
    return F.when(F.isnan(rate) | (rate == float("inf")), 1.0).otherwise(rate)


def accuracy(rate: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - rate)


def is_mark(ch: str) -> bool:
    """Whether a character is a nukta or a vowel sign (viramas are not), by its Unicode name."""
    name = unicodedata.name(ch, "")
    return "NUKTA" in name or "VOWEL SIGN" in name and "VIRAMA" not in name


@F.pandas_udf(StringType())
def without_marks(s: pd.Series) -> pd.Series:
    """Decomposed, without nuktas and vowel signs."""
    return pd.Series(_each(lambda t: "".join(ch for ch in unicodedata.normalize("NFD", t) if not is_mark(ch)), s), dtype="object")


def words(c: Column) -> Column:
    """Words by white space; [] for a blank text."""
    t = whitespace(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def longest_run(items: Column) -> Column:
    """struct(item, n): the first longest run of equal items; n is 0 for an empty array."""
    zero = F.struct(F.lit(None).cast("string").alias("item"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(1)
        better = run > acc["n"]
        return F.struct(F.when(better, x).otherwise(acc["item"]).alias("item"), F.when(better, run).otherwise(acc["n"]).alias("n"), x.alias("last"), run.alias("run"))

    return F.aggregate(items, zero, step, lambda a: F.struct(a["item"].alias("item"), a["n"].alias("n")))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of ``part``; 0 for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def tail_repeats(items: Column, n: int) -> Column:
    """How often the last ``n`` items repeat at the end of the array."""
    size = F.size(items)
    last = F.slice(items, F.greatest(size - n + 1, F.lit(1)), n)
    k = lambda i: F.slice(items, size - (i + 1) * n + 1, n) == last
    reps = F.aggregate(F.sequence(F.lit(0), F.greatest((size / n).cast("int") - 1, F.lit(0))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, i: F.struct(F.when(a["on"] & (size >= (i + 1) * n) & k(i), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & (size >= (i + 1) * n) & k(i)).alias("on")), lambda a: a["n"])
    return F.when(size >= n, reps).otherwise(0)


def repeated_text(gt: Column, hyp: Column) -> Column:
    """Whether ``hyp`` repeats a word, a closing phrase of 2-4 words, or the whole of ``gt``."""

    def repeats(g: Column, h: Column, run: Column) -> Column:
        by_word = (run["n"] >= 3) & (run["n"] > F.size(F.filter(g, lambda x: x == run["item"])) + 1)
        by_phrase = (tail_repeats(h, 2) >= 3) | (tail_repeats(h, 3) >= 3) | (tail_repeats(h, 4) >= 3)
        t = F.array_join(g, " ")
        return (F.size(h) > 0) & (by_word | by_phrase | ((F.length(t) > 0) & (occurrences(F.array_join(h, " "), t) >= 2)))

    return F.coalesce(let(words(gt), lambda g: let(words(hyp), lambda h: let(longest_run(h), lambda run: repeats(g, h, run)))), F.lit(False))


def reordered(gt: Column, hyp: Column) -> Column:
    """Same words, at least three, in another order."""
    g, h = words(gt), words(hyp)
    return F.coalesce((F.size(g) >= 3) & (F.size(h) >= 3) & (F.array_sort(g) == F.array_sort(h)) & (g != h), F.lit(False))


def misread(gt: Column, hyp: Column) -> Column:
    """Lengths within a factor of 0.4 and some, but at most three quarters, of the longer changed."""
    a, b = F.length(gt), F.length(hyp)
    lo, hi, dist = F.least(a, b), F.greatest(a, b), F.levenshtein(gt, hyp)
    return F.coalesce((lo > 0) & (lo >= 0.4 * hi) & (dist > 0) & (dist <= 0.75 * hi), F.lit(False))


def char_accuracy(g: Column, h: Column) -> Column:
    """1 minus distance over the truth's clusters, at least 0; an empty truth gives 1 for nothing, else 0."""
    n = F.size(g)
    return F.when(n == 0, (F.size(h) == 0).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - cluster_distance(g, h) / F.greatest(n, F.lit(1))))


def emitted_accuracy(g: Column, h: Column) -> Column:
    """Accuracy of what was emitted, against as much of the truth as that; nothing gives 1 for an empty truth, else 0."""
    n = F.size(h)
    prefix = F.slice(g, F.lit(1), F.greatest(n, F.lit(0)))
    return F.when(n == 0, (F.size(g) == 0).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - cluster_distance(prefix, h) / F.greatest(n, F.lit(1))))


def coverage(g: Column, h: Column) -> Column:
    """Share of the truth's clusters, counted with multiplicity, that the reading has; an empty truth is covered."""
    count = lambda v, x: F.size(F.filter(v, lambda y: y == x))
    shared = F.aggregate(F.array_distinct(g), F.lit(0), lambda s, x: s + F.least(count(g, x), count(h, x)))
    return F.when(F.size(g) == 0, 1.0).otherwise(shared / F.greatest(F.size(g), F.lit(1)))


def reward(accuracy: Column, covered: Column, teds: Column | None = None, tau: Column | None = None, penalty: float = 1.0) -> Column:
    """Accuracy, structure and order terms, less the penalty for what is not covered."""
    zero = F.lit(0.0)
    return accuracy + F.coalesce(teds if teds is not None else zero, zero) + F.coalesce(tau if tau is not None else zero, zero) - penalty * (1 - covered)


def omission(gt: Column, easy: Column) -> Column:
    """struct(beats, punished): whether leaving out the rest behind an easy beginning would pay without a coverage term, and whether that term prevents it.

    The beginning alone is compared with a whole reading whose rest is wrong.
    """
    whole = F.concat(easy, F.lit(" "), F.repeat(F.lit("x"), F.greatest(F.lit(1), F.char_length(gt) - F.char_length(easy))))
    g = graphemes(gt)
    part, full = emitted_accuracy(g, graphemes(easy)), emitted_accuracy(g, graphemes(whole))
    covered_by = covered(gt, easy)
    return F.struct(((reward(part, covered_by, penalty=0.0) > reward(full, covered(gt, whole), penalty=0.0) - 1e-9) & (covered_by < covered(gt, whole))).alias("beats"), (reward(part, covered_by) < reward(part, covered_by, penalty=0.0)).alias("punished"))


def charset(c: Column, trained: str, image: str) -> Column:
    """Counts and fractions of clusters in the trained, the image's and other scripts; fractions are null for blank texts."""
    g = F.filter(graphemes(c), lambda x: whitespace(x) != "")
    n = F.size(g)
    t = F.size(F.filter(g, lambda x: x.rlike(trained)))
    i = F.size(F.filter(g, lambda x: ~x.rlike(trained) & x.rlike(image)))
    part = lambda k: F.when(n > 0, k / F.nullif(n, F.lit(0)))
    return F.struct(n.alias("n_graphemes"), t.alias("n_trained_script"), i.alias("n_image_script"), (n - t - i).alias("n_other"), part(t).alias("trained_script_fraction"), part(i).alias("image_script_fraction"), part(n - t - i).alias("other_fraction"))


def encode(clusters: Column, vocabulary: Column, rare: int = 3, bos: int = 1, eos: int = 2) -> Column:
    """Ids of clusters by a map column, unknown ones as ``rare``, wrapped in start and end."""
    return F.concat(F.array(F.lit(bos)), F.transform(clusters, lambda g: F.coalesce(F.get(F.map_values(F.map_filter(vocabulary, lambda k, v: k == g)), F.lit(0)), F.lit(rare))), F.array(F.lit(eos)))


def decode(ids: Column, clusters: Column) -> Column:
    """Text of ids by a map column from id to cluster; special ids (0-3) are left out."""
    return F.array_join(F.transform(F.filter(ids, lambda i: i > 3), lambda i: F.get(F.map_values(F.map_filter(clusters, lambda k, v: k == i)), F.lit(0))), "")


def stable_seed(key: Column) -> Column:
    """The first 32 bits of the SHA-256 of a key, as a number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def stable_int(key: Column) -> Column:
    """The first 32 bits of the MD5 of a key, as a number: what all seeded draws are made of."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
