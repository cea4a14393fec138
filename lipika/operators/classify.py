"""Ordered classifications (B7-B19) as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lipika.functions import text

#: Languages for which phonetic equivalence is defined.
TIER2_LANGUAGES = ("hindi", "bengali")
# Inclusive position buckets.
POSITION_BUCKETS = (("0", 0, 0), ("1", 1, 1), ("2-9", 2, 9), ("10-19", 10, 19), ("20-39", 20, 39), ("40+", 40, None))


def outcome(gt: Column, hyp: Column, gt_form: Column, hyp_form: Column, language: Column, human: Column, tier2: Column | None = None) -> Column:
    """EXACT, TIER1, TIER2, GENUINE or UNREVIEWED, in this order; ``tier2`` is false where no phonetic table is at hand."""
    same = gt_form == hyp_form
    phonetic = language.isin(*TIER2_LANGUAGES) & F.coalesce(tier2 if tier2 is not None else F.lit(False), F.lit(False))
    strip = lambda c: F.regexp_replace(c, rf"^{text.BLANKS}+|{text.BLANKS}+$", "")
    return F.when(same & (strip(gt) == strip(hyp)), "EXACT").when(same, "TIER1").when(phonetic, "TIER2").when(F.coalesce(human, F.lit("")) != "", "GENUINE").otherwise("UNREVIEWED")


def review_outcome(gt: Column, hyp: Column, gt_form: Column, hyp_form: Column, language: Column, tier2: Column | None = None) -> Column:
    """As :func:`outcome` for the reviewer: EXACT compares after joining white space."""
    phonetic = language.isin(*TIER2_LANGUAGES) & F.coalesce(tier2 if tier2 is not None else F.lit(False), F.lit(False))
    return F.when(text.whitespace(gt) == text.whitespace(hyp), "EXACT").when(gt_form == hyp_form, "TIER1").when(phonetic, "TIER2").otherwise("UNEXPLAINED")


def residual_label(gt: Column, hyp: Column, gt_bare: Column, hyp_bare: Column) -> Column:
    """Suggested label of what no tier explains, by priority; null where nothing fits or the texts are equal.

    All four texts are white-space-normalised; the bare ones are without vowel signs and nuktas.
    """
    dropped = (gt_bare == hyp_bare) & ((gt_bare != gt) | (hyp_bare != hyp))
    return F.when(gt == hyp, None).when(text.repeated_text(gt, hyp), "hallucinated-repeated-text").when(text.reordered(gt, hyp), "reading-order-break").when(dropped, "dropped-matra-nukta").when(text.misread(gt, hyp), "genuine-misread")


def position_bucket(i: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(POSITION_BUCKETS):
        out = F.when((i >= lo) & (F.lit(True) if hi is None else i <= hi), name).otherwise(out)
    return out


# Sizes (as parts of the page) by which a page's layout is told, and the names of layouts.
LAYOUT = {
    "table_height": 0.18, "table_width": 0.25, "table_area": 0.08, "body_width": 0.20, "body_height": 0.15, "column_gap": 0.25,
    "left_edge": 0.08, "right_edge": 0.92, "margin_width": 0.18, "margin_height": 0.20,
}
LAYOUTS = ("form", "table-embedded", "two-column", "marginalia", "single-column")
# How two clusters are alike, and how many code points apart neighbours lie.
TAGS = ("empty", "identical", "same-base-matra-diff", "same-base", "adjacent-codepoint", "both-devanagari", "dissimilar")
NEIGHBOURS = 5


def layout_category(regions: Column) -> Column:
    """The first of :data:`LAYOUTS` whose test the regions of a page pass; the last has none.

    Any form field makes a form. One large table, or enough table area in all,
    makes a page with tables. Two text bodies side by side are told by how far
    apart their centres lie. A region of kind margin, or a narrow and tall one
    near the left or right border, makes marginalia.
    """
    x = LAYOUT
    kind = lambda r, name: F.coalesce(r["kind"], F.lit("")) == name
    tables = F.filter(regions, lambda r: kind(r, "table"))
    area = F.aggregate(tables, F.lit(0.0), lambda a, r: a + r["width"] * r["height"])
    table = F.exists(tables, lambda r: (r["height"] >= x["table_height"]) & (r["width"] >= x["table_width"])) | (area >= x["table_area"])
    bodies = F.transform(F.filter(regions, lambda r: kind(r, "text") & (r["width"] >= x["body_width"]) & (r["height"] >= x["body_height"])), lambda r: r["x"] + r["width"] / 2)
    spread = (F.size(bodies) >= 2) & (F.array_max(bodies) - F.array_min(bodies) >= x["column_gap"])
    border = lambda r: (r["x"] < x["left_edge"]) | (r["x"] + r["width"] > x["right_edge"])
    margin = F.exists(regions, lambda r: kind(r, "margin") | (border(r) & (r["width"] < x["margin_width"]) & (r["height"] > x["margin_height"])))
    tests = (F.exists(regions, lambda r: kind(r, "form_field")), table, spread, margin)
    return F.coalesce(*[F.when(t, name) for t, name in zip(tests, LAYOUTS)], F.lit(LAYOUTS[-1]))


def confusion_tag(a: Column, b: Column) -> Column:
    """How two clusters are alike, by their first code points: the first of :data:`TAGS` that fits."""
    x, y = F.ascii(a), F.ascii(b)
    both = x.between(0x0900, 0x097F) & y.between(0x0900, 0x097F)
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    tests = (empty, a == b, (x == y) & (F.char_length(a) != F.char_length(b)), x == y, both & (F.abs(x - y) <= NEIGHBOURS), both)
    return F.coalesce(*[F.when(t, name) for t, name in zip(tests, TAGS)], F.lit(TAGS[-1]))


def curve_reading(points: Column, first_loss: Column, last_loss: Column, gap_change: Column) -> Column:
    """What a training curve says: (a) loss falls while the gap stays, (b) the gap widens, modest, or undecided."""
    ratio = F.when(last_loss > 0, first_loss / last_loss)
    flat = F.abs(gap_change) < 0.05
    return F.when(points < 2, "insufficient").when((ratio >= 100) & flat, "a").when(gap_change > 0.05, "b").when(ratio < 10, "modest").otherwise("undecided")


def feasibility(natural: Column, flattened: Column, inverted: Column, crossover: Column) -> Column:
    """All reasons against a fit over three conditions' accuracies, as an array; empty where it is feasible."""
    n, f, i = F.coalesce(natural, F.lit(0.0)), flattened, inverted
    return F.array_compact(F.array(
        F.when(n < 0.05, "natural below 5 %"), F.when((F.coalesce(f, F.lit(1.0)) < 0.02) & (F.coalesce(i, F.lit(1.0)) < 0.02), "flattened and inverted below 2 %"),
        F.when(F.coalesce(f, F.lit(0.0)) < 0.05, "flattened below 5 %"), F.when(crossover < 50, "fewer than 50 in common"),
    ))


def script_class(g: Column, trained: str, image: str) -> Column:
    return F.when(F.trim(g) == "", "other").when(g.rlike(trained), "trained").when(g.rlike(image), "image").otherwise("other")


def review_note(typed: Column, suggestion: Column) -> Column:
    """struct(outcome, label) of a reviewer's answer: a skip, the suggestion confirmed (also by an empty answer), or a label of their own."""
    fits, t = suggestion.isNotNull(), F.coalesce(typed, F.lit(""))
    skip = F.lower(t).isin("s", "skip") | ((t == "") & ~fits)
    confirm = fits & ((t == "") | (t == suggestion))
    outcome = F.when(skip, "skipped").when(confirm, "agent-suggested-and-confirmed").otherwise("human-overridden")
    return F.struct(outcome.alias("outcome"), F.when(~skip, F.when(confirm, suggestion).otherwise(t)).alias("label"))


def adjudicated(label: Column, outcome: Column) -> Column:
    """Whether a note settles its row: it has a label and is neither pending nor skipped."""
    return label.isNotNull() & ~F.coalesce(outcome, F.lit("")).isin("pending-adjudication", "skipped")
