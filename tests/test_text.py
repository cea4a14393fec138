import random
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from lipika.functions import text as t


def col(spark, values, f, names="v"):
    if isinstance(names, str):
        values = [(v,) for v in values]
        names = [names]
    d = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r.o for r in d.withColumn("o", f(*[F.col(n) for n in names])).orderBy("i").collect()]


def test_graphemes(spark):
    fixed = ["क्ष", "का", "किताब", "", None, "é", "👩‍👩‍👧x", "\r\n"]
    r = random.Random(1)
    more = ["".join(r.choice("कखगज्ि़ंাকখ্যé́ab ‍") for _ in range(r.randrange(12))) for _ in range(300)]
    got = col(spark, fixed + more, t.graphemes)
    assert got[:3] == [["क्ष"], ["का"], ["कि", "ता", "ब"]] and got[4] is None
    assert [g for g in got if g is not None] == [regex.findall(r"\X", s) for s in fixed + more if s is not None]


def test_tier1(spark):
    # Pairs of writings that are one reading.
    same = [("२०२४", "2024"), ("तिम्रा।", "तिम्रा."), ("हिन्दी", "हिंदी"), ("सम्बन्ध", "सम्बंध"), ("है ।", "है।"), ("यह।", "यह|"), ("रात॥", "रात .."), ("a \n b", "a b"), ("ত্‍", "ৎ"), ("||", "॥")]
    got = col(spark, [*same, ("अ", "आ"), ("", " ")], lambda a, b: t.tier1(a) == t.tier1(b), ["a", "b"])
    assert got == [True] * len(same) + [False, True]


def levenshtein(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_cluster_distance_and_rates(spark):
    r = random.Random(2)
    pairs = [("".join(r.choice("कखि्aé ") for _ in range(r.randrange(9))), "".join(r.choice("कखि्aé ") for _ in range(r.randrange(9)))) for _ in range(150)]
    got = col(spark, pairs, lambda a, b: t.cluster_distance(t.graphemes(a), t.graphemes(b)), ["a", "b"])
    assert got == [levenshtein(regex.findall(r"\X", a), regex.findall(r"\X", b)) for a, b in pairs]
    rate = lambda empty: col(spark, [("ab", "ax"), ("", ""), ("", "x"), ("a", "bcd")], lambda a, b: t.error_rate(t.cluster_distance(t.graphemes(a), t.graphemes(b)), F.length(a), F.length(b), empty), ["a", "b"])
    assert rate("inf") == [0.5, 0.0, float("inf"), 3.0] and rate("one")[2] == 1.0


def test_signals(spark):
    # The first pairs.
    f = lambda g: lambda a, b: g(a, b)
    pairs = [("राम", "राम राम राम राम"), ("राम सीता लक्ष्मण", "सीता राम लक्ष्मण"), ("राम", "श्याम"), ("राम", ""), ("a b", "x a b a b a b"), ("hello you", "hello you hello you")]
    assert col(spark, pairs, f(t.repeated_text), ["a", "b"]) == [True, False, False, False, True, True]
    assert col(spark, pairs, f(t.reordered), ["a", "b"]) == [False, True, False, False, False, False]
    assert col(spark, pairs, f(t.misread), ["a", "b"])[2] is True
    assert col(spark, ["किताब", "क़", None], t.without_marks) == ["कतब", "क", None]
    assert unicodedata.is_normalized("NFC", col(spark, ["é"], t.nfc)[0])


def test_charset_and_codes(spark):
    c = col(spark, ["कᱚ", "", None], lambda v: t.charset(v, r"[ऀ-ॿ]", r"[ᱚ-ᱽ]"))
    assert c[0].trained_script_fraction == c[0].image_script_fraction == 0.5 and c[1].trained_script_fraction is None
    vocab = F.create_map(F.lit("a"), F.lit(4), F.lit("b"), F.lit(5))
    back = F.create_map(F.lit(4), F.lit("a"), F.lit(5), F.lit("b"))
    d = spark.range(1).select(t.encode(F.array(F.lit("a"), F.lit("z"), F.lit("b")), vocab).alias("e"))
    assert d.first().e == [1, 4, 3, 5, 2] and d.select(t.decode(F.col("e"), back)).first()[0] == "ab"


def test_rewards(spark):
    pairs = [("किताब", "किताब"), ("किताब", ""), ("", ""), ("", "x"), ("easy and long", "easy"), ("aab", "ab")]
    f = lambda g: col(spark, pairs, lambda a, b: g(t.graphemes(a), t.graphemes(b)), ["a", "b"])
    assert f(t.char_accuracy) == [1.0, 0.0, 1.0, 0.0, pytest.approx(4 / 13), pytest.approx(2 / 3)]
    assert f(t.emitted_accuracy) == [1.0, 0.0, 1.0, 0.0, 1.0, pytest.approx(0.5)]
    assert f(t.coverage) == [1.0, 0.0, 1.0, 1.0, pytest.approx(4 / 13), pytest.approx(2 / 3)]
    r = f(lambda g, h: t.reward(t.emitted_accuracy(g, h), t.coverage(g, h)))
    assert r[0] == 1.0 and r[1] == -1.0


# Pairs of writings in Hindi (h) or Bengali (b) that sound the same, and that don't.
SAME_SOUND = [
    ("क़िताब", "क\u093cिताब", "h"), ("फ़ोन", "फ\u093cोन", "h"), ("ज़मीन", "ज\u093cमीन", "h"), ("ख़ुशी", "ख\u093cुशी", "h"), ("ग़लत", "ग\u093cलत", "h"), ("बड़ा", "बड\u093cा", "h"), ("पढ़ा", "पढ\u093cा", "h"),
    ("ড়", "ড\u09bc", "b"), ("ঢ়", "ঢ\u09bc", "b"), ("য়", "য\u09bc", "b"), ("হয়", "হয\u09bc", "b"), ("क्ष", "क्\u200dष", "h"), ("अक्षर", "अक्\u200dषर", "h"), ("प्रज्ञा", "प्रज्\u200dञा", "h"), ("लक्ष्मण", "लक्\u200dष्मण", "h"),
    ("धर्म", "धर्\u200dम", "h"), ("ক্ষমা", "ক্\u200cষমা", "b"), ("বিদ্যালয়", "বিদ্\u200dযালয়", "b"), ("ॐ", "ओं", "h"), ("ॐ नमः", "ओं नमः", "h"), ("ৎ", "ত্", "b"), ("উৎসব", "উত্সব", "b"), ("भारत", "भा\u200cरत", "h"),
]
OTHER_SOUND = [
    ("राम", "श्याम", "h"), ("कमल", "कमला", "h"), ("कमल", "कमाल", "h"), ("दिन", "दीन", "h"), ("सुर", "सूर", "h"), ("बाल", "बल", "h"), ("नमः", "नमस्", "h"), ("আম", "আমি", "b"), ("ভালো", "ভাল", "b"), ("দিন", "দীন", "b"),
    ("নদী", "নদি", "b"), ("শ", "স", "b"), ("हिन्दी", "हिंदी", "h"), ("गङ्गा", "गंगा", "h"), ("পণ্ডিত", "পংডিত", "b"),
]


def test_phonetic_equivalence(spark):
    import duckdb

    from lipika.plans.views import phonetic_sql

    cases = [(a, b, {"h": "hindi", "b": "bengali"}[x]) for a, b, x in SAME_SOUND + OTHER_SOUND] + [("a", "a", "santhali"), ("क", None, "hindi"), ("क", "क", None), ("क्आ", "का", "hindi"), ("क्अ", "क", "hindi"), ("अइ", "ऐ", "hindi"), ("", "", "hindi")]
    want = [True] * len(SAME_SOUND) + [False] * len(OTHER_SOUND) + [False, False, False, True, True, False, True]
    assert col(spark, cases, t.tier2, ["a", "b", "c"]) == want
    db = duckdb.connect()
    db.execute("create table p (i int, a varchar, b varchar, c varchar)")
    db.executemany("insert into p values (?, ?, ?, ?)", [(i, *x) for i, x in enumerate(cases)])
    assert [bool(x[0]) for x in db.execute(f"select {phonetic_sql('a', 'c')} = {phonetic_sql('b', 'c')} from p order by i").fetchall()] == want
    assert t._iso("कमल प्रज्ञा १२।", "hindi") == "kamala prajñā 12." and t._iso("উৎসব", "bengali") == "utsaba"


def test_distances_in_lockstep():
    r = random.Random(5)
    some = lambda: ["".join(r.choice("abक")) for _ in range(r.randrange(14))]
    pairs = [(some(), some()) for _ in range(400)]
    assert t.distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [levenshtein(a, b) for a, b in pairs]


def test_tier1_step_by_step(spark):
    """The few passes against one replacement after another."""

    def slow(v):
        v = " ".join(unicodedata.normalize("NFC", v).split())
        for nasal, (first, last) in t.NASALS.items():
            for k in range(ord(first), ord(last) + 1):
                v = v.replace(f"{nasal}\u094d{chr(k)}", f"\u0902{chr(k)}")
        for a, b in t.SAME_READING.items():
            v = v.replace(a, b)
        return regex.sub(r"\s+(\.+)", r"\1", v.translate(str.maketrans(t.SINGLE_FROM, t.SINGLE_TO)))

    r = random.Random(9)
    texts = ["".join(r.choice("कडजनतथमङञण्््\u093c\u09bcডযত\u09cd\u200d\u200c।॥| .१৪") for _ in range(r.randrange(16))) for _ in range(800)]
    assert col(spark, texts, t.tier1) == [slow(v) for v in texts]
