import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lipika.llm import sentences as S

DOCS = "doc_id long, text string, start_pos string, Text string"

CASES = [
    (["Dr. K. Lem read it.", "It was dry."], " "), (["See Fig. 9 and vol. 19 for it.", "Boxes held ink, etc.", "The end?!"], " "),
    (["Some marks, e.g. the first, were lost.", "It weighed approx. 40.2 kg, i.e. less.", "At 10.30 a.m. in Lem it fell."], " "),
    (["The map was ... then again was not ... the map.", "It went missing...", "Now it is here."], " "),
    (['A said, "One. Two." and left.', 'B wrote, "One! Two."', "C left."], " "), (["A typed “X. Y.” into the form.", "(Wholly in brackets.)", "It (cf. p. 9) fell."], " "),
    (["पृ. १३ का नक्शा टूट गया।", "डॉ. लल और एस. आर. काल आए।", "दूरी ०.५ कि.मी. बताई गई॥"], " "), (["सं. ९१ वाली पंक्ति पूचा से आई.", "क्या वह गया?", "वह गया|"], " "),
    (["उसने कहा, “एक। दो।” — और गया।", "उसने लिखा, \"एक। दो।\"", "वह गया ।"], " "), (["एक गया।", "दो गया।"], ""), (["নং. ২৭ এসেছে।", "বি. এস. রোচা ০.৯ কি.মি. গেল।"], " "),
    (["ᱥᱟ. 301 ᱨᱮ ᱯᱩᱮᱱᱟ᱿", "ᱞ. ᱞ. ᱥᱟᱥᱩ ᱠᱤᱮᱱᱟ ᱾"], " "), (["ص۔ ۲ پیٹھ خط آو۔", "تام ۰.۶ ک۔م۔ آو نہ۔", "کیا موٹ؟"], " "),
    (["図5の本は消された。", "「一。二。」とニカは言った。", "第1.5版！"], ""), (["1) First one.", "2) Second one.", "3.\nThird one."], "\n"),
    (["آو۔", "ص۔ ۲ پیٹھ تام ۰.۶ ک۔م۔ گو۔", "PDF اوس۔"], ""), (["पूचा से आई.", "एस. आर. लल ने लिखा."], " "), (["Boxes held ink, etc.", "surya gave 0.5 for it."], " "),
    (['A said, "One."', "With it B fell.", 'C SAID, "ONE." AND LEFT.'], " "), (["A heading", "Text here"], "\n \r\n\n"), (["A single\nline break"], " "), (["กา นา".replace(" ", "\n")], " "), (["ค่า KL เฉลี่ย 0.26 แต่หาย", "เขาว่า“กา นา”แล้วไป", "จบ"], " "),
]


def test_cases():
    for parts, glue in CASES:
        text = glue.join(parts)
        assert [text[a:b] for a, b in S.boundaries(text)] == parts, parts


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aA1 .!?।“”\"()\n\r|…กข 。」「—"), max_size=60))
def test_spans_cover_all_but_blanks(t):
    at = 0
    for a, b in S.boundaries(t):
        assert at <= a < b and not t[at:a].strip() and not t[a].isspace() and not t[b - 1].isspace()
        at = b
    assert not t[at:].strip()


def test_long_texts_take_linear_time():
    for t in ("( " * 100_000, "a | b " * 100_000, "word. " * 100_000, "x" * 500_000, "“" * 50_000 + "”" * 50_000, "\n" * 300_000):
        S.boundaries(t)


def test_tables(spark):
    rows = [(1, "One. Two.", "x", None), (1, "One. Two.", "x", None), (2, None, "x", None), (3, "", "x", None), (4, " \n ", "x", None), (None, "One.", "x", None), (5, "no mark", "x", "y")]
    got = sorted(tuple(r) for r in S.sentences(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (5, 0, 7)]
    assert S.sentences(spark.createDataFrame([], DOCS)).count() == 0


def test_lattice():
    assert S.lattice_words("とても", "ja")[0] == "とても" and S.lattice_words("とニカ", "ja")[0] == "と"
    assert S.lattice_words("これは犬です", "ja") == ["これ", "は", "犬", "です"] and S.lattice_words("กา", "th") == ["กา"]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("とてもころですはへえ犬猫"), max_size=12))
def test_lattice_against_all_segmentations(run):
    words = {*S.FINAL["ja"], *S.FOLLOW["ja"], *S.OPENER["ja"]}
    price = [0.0]
    for end in range(1, len(run) + 1):
        price.append(min([price[end - 1] + S.UNKNOWN_LETTER, *(price[end - len(w)] + 1 for w in words if run[:end].endswith(w))]))
    got = S.lattice_words(run, "ja")
    assert "".join(got) == run and all(got)
    assert abs(sum(1 if w in words else S.UNKNOWN_LETTER * len(w) for w in got) - price[-1]) < 1e-6


MORE = [
    (["这是书。", "那是笔。"], ""), (["これは犬です", "これは猫です"], " "), (["犬と猫 は走った"], " "), (["ཁྱེད་རང་ག་པར་ཕེབས།", "ང་ཚོ་འགྲོ།"], " "), (["ຂ້ອຍໄປຕະຫຼາດແລ້ວ", "ລາວກິນເຂົ້າ"], " "),
    (["ខ្ញុំទៅផ្សារ។", "គាត់ញ៉ាំបាយ។"], " "), (["Sgt. Lem and Lt. Tol left.", "It was on Jan. 5."], " "), (["We met Acme Corp. Smith on Jan. 5."], " "), (["It joined Acme Corp.", "The rest stayed."], " "),
    (["Ink, paper, etc. were lost."], " "), (["वह आई.", "आई. के. राय गए."], " "), (["ไปแล้วครับ", "แต่กา"], " "), (["นา ๆ", "กา"], " "),
]


def test_more_scripts():
    for parts, glue in MORE:
        text = glue.join(parts)
        assert [text[a:b] for a, b in S.boundaries(text)] == parts, parts


def test_path_is_the_cheapest():
    """The path against all readings of a few marks."""
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(["word", "1", "a", "?", ".", " ", "(b!)", "\n", " | ", '"c."', "।"]) for _ in range(9)).strip()
        if not text:
            continue
        nodes = S._nodes(text, 0, len(text))

        def total(ends):
            cost, begin = 0.0, 0
            for j, (s, _, after, inside, end, kind) in enumerate(nodes):
                if j not in ends:
                    cost += inside
                    continue
                cost += end + S._between(text, begin, s, kind)
                if j + 1 < len(nodes) and nodes[j + 1][5] in ("mark", "number") and not text[after : nodes[j + 1][0]].strip():
                    cost += S.EMPTY
                begin = after
            return cost

        best = min(total({j for j in range(len(nodes)) if bits >> j & 1}) for bits in range(1 << len(nodes)))
        assert abs(total(set(S._cheapest(text, 0, nodes))) - best) < 1e-9, text
