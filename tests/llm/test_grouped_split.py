import random

from lipika.llm import grouped_split as g
from lipika.llm import components as C
from lipika.llm.components import components

PAGES = "page_id long, script string, mode string, page_idx int, stem string, layout_source string, tier string, layout_category string, Stem string"
BANK = "layout_id long, source string, source_id string"
LINES = "line_id long, image_path string, line_index int, text string"


def union(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_against_union_find(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (7, None)]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union([(a, b) for a, b in pairs if b is not None and a != b])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def tables(spark):
    pages = [
        (1, "hindi", "natural", 3, "natural_page0003", "local:lem-roll-1000", "A", "form", "x"),
        (2, " HINDI\t", "natural", None, "natural_page0003", None, "A", None, "x"),
        (3, "hindi", "natural", 4, "natural_page0004", "LOCAL: Lem_Roll_1000 (retry)", None, "form", "x"),
        (4, "bengali", "natural", 3, "natural_page0003", "scans/lem-roll-1000.jpg", "B", "form", "x"),
        (5, "hindi", "natural", 12345, "natural_page12345", "lem-roll-10001", "A", "form", "x"),
        (6, "hindi", "flattened", 3, "flattened_page0003", "unknown", "A", "form", "x"),
        (7, None, "natural", 3, None, "", "A", "form", "x"),
        (8, "hindi", "natural", 4, "natural_page0004", "xlem-roll-1000", "A", "form", "x"),
    ]
    bank = [(1, "local", "lem-roll-1000"), (2, "wikipedia", "lem-roll-1000"), (3, "local", "other-roll-7"), (4, "local", None)]
    return spark.createDataFrame(pages, PAGES), spark.createDataFrame(bank, BANK)


def test_components_of_many_tasks(spark):
    """Star rounds, where no task holds all links."""
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(200)] + [(r.randrange(500, 900), r.randrange(500, 900)) for _ in range(300)]
    C.HELD, kept = 20, C.HELD
    try:
        got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    finally:
        C.HELD = kept
    assert got == union([(a, b) for a, b in pairs if a != b])


def test_sources_by_letters_and_whole_numbers(spark):
    bank = spark.createDataFrame([(1, "x", "wiki12"), (2, "x", "lem-wiki12-a"), (3, "x", "-"), (4, "x", None), (5, "x", "গ৭")], BANK)
    named = {1: "Wiki-12 v2", 2: "xwiki12", 3: "wiki123", 4: "scan7/WIKI 12.png", 5: "2wiki12", 6: "wiki", 7: "Lem_Wiki 12/A", 8: None, 9: "", 10: "<wiki> 1 2", 11: "ক গ-৭"}
    pages = spark.createDataFrame(list(named.items()), "page_id long, layout_source string")
    assert {tuple(r) for r in g.sources_named(pages, bank).collect()} == {(k, "wiki<12>") for k in (1, 2, 4, 5)} | {(7, "lemwiki<12>a"), (11, "গ<৭>")}


def test_every_component_goes_where_its_label_is_needed_most():
    r = random.Random(6)
    vectors = [{"*=page": r.randrange(1, 5), f"a={r.randrange(3)}": 1, **({f"rare={r.randrange(4)}": 1} if r.random() < 0.1 else {})} for _ in range(400)]
    for v in vectors:
        v.update({x: v["*=page"] for x in v if x != "*=page"})
    total = {}
    for v in vectors:
        for x, n in v.items():
            total[x] = total.get(x, 0) + n
    classes = {}
    for v in vectors:
        classes.setdefault(tuple(sorted(v.items())), []).append(v)
    placed = g.Needs(total, g.SPLITS).place([(str(k), dict(k), len(c)) for k, c in sorted(classes.items())])
    took = {name: s for name, *s in placed}
    assert all(sum(took[str(k)]) == len(c) and min(took[str(k)]) >= 0 for k, c in classes.items())
    for x, n in total.items():
        for i, share in enumerate(g.SPLITS.values()):
            got = sum(dict(k)[x] * took[str(k)][i] for k in classes if x in dict(k))
            assert abs(got - n * share) <= 5 + 0.03 * n, (x, i)


def test_tied_pages(spark):
    assert {tuple(r) for r in g.tied(*tables(spark)).collect()} == {(1, 2), (1, 3), (1, 4), (1, 8)}


def test_empty_tables(spark):
    pages, bank = tables(spark)
    assert g.tied(pages.limit(0), bank).count() == 0
    assert {tuple(r) for r in g.tied(pages, bank.limit(0)).collect()} == {(1, 2), (3, 8)}


def test_groups_stay_together_and_shares_hold(spark):
    r = random.Random(5)
    pages = [(i, r.choice(["hindi", "bengali"]), "natural", i // 2, f"natural_page{i // 2:04d}", f"s-roll-{r.randrange(400)}" if r.random() < 0.4 else None, "A", r.choice(["form", "two-column"]), "x") for i in range(1200)]
    bank = [(i, "local", f"s-roll-{i}") for i in range(400)]
    lines = [(i, f"data\\cache/line_crops/{p[1]}/natural_page{p[3]:04d}_r{i % 3:04d}.png", None, "t") for i, p in enumerate(r.choices(pages, k=2500))] + [(9000, "nonsense", 1, None), (9001, None, None, None)]
    args = spark.createDataFrame(pages, PAGES), spark.createDataFrame(lines, LINES), spark.createDataFrame(bank, BANK)
    for block in (7, 100_000):
        g.BLOCK, kept = block, g.BLOCK
        d = g.assign(*args).toPandas()
        assert len(d) == len(pages) + len(lines) and not d.duplicated(["record_kind", "record_id"]).any()
        g.BLOCK = kept
        assert d.groupby("component").split.nunique().max() == 1
        share = d.split.value_counts(normalize=True)
        assert abs(share["train"] - 0.8) < 0.05 and abs(share["test"] - 0.1) < 0.05
    by_page = {p[0]: (p[1], p[3]) for p in pages}
    where = {by_page[i]: s for k, i, s in zip(d.record_kind, d.record_id, d.split) if k == "page"}
    for (i, path, *_), s in zip(lines, d[d.record_kind == "line"].sort_values("record_id").split):
        if path and "page" in path:
            parts = path.replace("\\", "/").split("/")
            assert where[(parts[-2], int(parts[-1][12:16]))] == s
