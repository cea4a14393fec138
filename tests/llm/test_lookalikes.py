from hypothesis import given, settings
from hypothesis import strategies as st

from lipika.llm import lookalikes as L

PROBE = "probe_id long, ground_truth string, sarvam_text string, Sarvam_Text string"
PAGES = "page_id long, text string, canon_text string"
FORM = L.rewriter(L.representatives({}))

SAME = [("ＯＣＲ ２", "OCR 2"), ("ड़", "ड़"), ("क​ख", "कख"), ("a b", "a b"), ("СΕR", "CER"), ("अा", "आ"), ("अौ", "औ"), ("কো", "কো"), ("آ", "آ"), ("ك", "ک"), ("అఆల", "ಅಆಲ"), ("၀", "ဝ"), ("୦", "ଠ"), ("అ౧", "ಅ೧")]
DIFFERENT = [("१", "1"), ("①", "1"), ("⁵", "5"), ("।", "."), ("सम्बन्ध", "संबंध"), ("a b", "ab"), ("a\nb", "a b"), ("क", "ख"), ("O", "0")]


def test_pairs():
    for a, b in SAME:
        assert FORM(a) == FORM(b), (a, b)
    for a, b in DIFFERENT:
        assert FORM(a) != FORM(b), (a, b)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("कअाौोेडɑaаоАA़​  1１。ｶ゙ﾞ"), max_size=30))
def test_form_is_stable(t):
    assert FORM(FORM(t)) == FORM(t)


def test_classes_are_transitive():
    c = L.classes([("a", "b"), ("b", "c"), ("x", "y")])
    assert sorted(map(sorted, c)) == [["a", "b", "c"], ["x", "y"]]


def test_commonest_member_represents():
    rep = L.representatives({"А": 5, "A": 1})
    assert rep["A"] == "А" and "А" not in rep


def test_same_looking_against_brute_force(spark):
    probe = [(i, a, b, "x") for i, (a, b) in enumerate(SAME + DIFFERENT)] + [(90, None, "a", "x"), (91, "a", "a", "x"), (92, "", "​", "x"), (93, "", "", None)]
    texts = ["आम OCR", "अाम OCR", "आम ОCR", "आम OCR", None, "", "अाम OCR", "other"]
    pages = [(i, t, "clash") for i, t in enumerate(texts)]
    got = {tuple(r) for r in L.same_looking(spark.createDataFrame(probe, PROBE), spark.createDataFrame(pages, PAGES)).collect()}
    want = {("probe", i, i) for i in range(len(SAME))} | {("probe", 92, 92)}
    want |= {("page", i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a and b and a != b and FORM(a) == FORM(b)}
    assert got == want
    none = spark.createDataFrame([], PROBE), spark.createDataFrame([], PAGES)
    assert L.same_looking(*none).count() == 0 and L.normalised(*none).count() == 0
    out = {(r.record_kind, r.record_id, r.field): r.text for r in L.normalised(spark.createDataFrame(probe, PROBE), spark.createDataFrame(pages, PAGES)).collect()}
    assert out[("probe", 90, "ground_truth")] is None and out[("page", 5, "text")] == "" and out[("page", 0, "text")] == out[("page", 1, "text")]


def test_long_text():
    assert len(FORM("अा" * 200_000)) == 200_000


def test_pairs_of_a_hot_writing_in_cells(spark):
    texts = ["आम OCR"] * 30 + ["अाम OCR"] * 25 + ["आम ОCR", "other", "other", None]
    pages = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], PAGES)
    L.CELL, kept = 4, L.CELL
    try:
        found = L.members(pages, "page_id", "text", L.representatives({}))
        got = sorted(tuple(r) for r in L.pairs_within(found, "page_id").collect())
    finally:
        L.CELL = kept
    want = sorted((i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a and b and a != b and FORM(a) == FORM(b))
    assert got == want
    assert sorted((r.texts, r.writings) for r in L.look_classes(found).collect()) == [(2, 1), (56, 3)]


def test_scripts_that_share_letters():
    for a, b in [("అఆల", "ಅಆಲ"), ("၀", "ဝ"), ("୦", "ଠ"), ("Ꭺ", "A"), ("Տ", "S"), ("ำ", "ํา"), ("ஔ", "ஒள")]:
        assert FORM(a) == FORM(b), (a, b)
    for a, b in [("క", "ಕ"), ("௧", "1"), ("ก", "ກ"), ("α", "a")]:
        assert FORM(a) != FORM(b), (a, b)
