import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lipika.functions import arrays, digests, special
from lipika.operators import aggregates, alignment, classify, joins, ordering, sampling, skew, stats


def test_numbered_and_running(spark):
    r = random.Random(1)
    d = pd.DataFrame({"g": [r.choice("aaab") if i % 9 else None for i in range(500)], "x": [r.randrange(20) for _ in range(500)], "i": range(500)})
    s = spark.createDataFrame([tuple(x) for x in d.itertuples(index=False)], "g string, x int, i int").repartition(6)
    got = ordering.numbered(s, ["g"], [F.col("x").desc(), F.col("i")], "rn", "n").toPandas().sort_values("i")
    want = d.fillna("-").sort_values(["x", "i"], ascending=[False, True]).groupby("g").cumcount().sort_index() + 1
    assert got.rn.tolist() == want.tolist() and got.n.tolist() == d.fillna("-").groupby("g").g.transform("size").tolist()
    t = ordering.running(s, [F.col("i")], {"t": F.col("x")}).toPandas().sort_values("i")
    assert t.t.tolist() == d.x.cumsum().tolist()
    assert ordering.numbered(s.limit(0), ["g"], [F.col("i")]).count() == 0


def test_midranks_and_tiles(spark):
    x = [3, 1, 3, 2, 3, None, 1]
    s = spark.createDataFrame([(v,) for v in x], "x int")
    m = {r.x: r.midrank for r in ordering.midranks(s, [], "x").collect()}
    assert m == {1: 1.5, 2: 3.0, 3: 5.0}
    for n, k in ((10, 3), (7, 7), (5, 10), (100, 10)):
        got = [r.b for r in spark.range(1, n + 1).select(ordering.tile(F.col("id"), F.lit(n), k).alias("b")).collect()]
        assert got == [i + 1 for i, part in enumerate(np.array_split(range(n), k)) for _ in part]


def test_lookup_join_with_a_hot_key(spark):
    big = spark.createDataFrame([(1, i) for i in range(300)] + [(k, 0) for k in range(2, 60)] + [(None, 5)], "k int, v int")
    small = spark.createDataFrame([(k, k * 10) for k in range(1, 50)], "k int, w int")
    assert skew.hot_keys(big, ["k"], 0.3, 100) == [(1,)]
    for how in ("left", "inner"):
        got = sorted(map(tuple, skew.lookup_join(big, small, ["k"], how, 0.3, 100).collect()), key=str)
        assert got == sorted(map(tuple, big.join(small, "k", how).collect()), key=str)


def test_rank_statistics(spark):
    up = spark.createDataFrame([(float(i), float(10 * i), i > 2) for i in range(1, 5)], "x double, y double, ok boolean")
    assert stats.spearman(up, [], "x", "y").first().rho == pytest.approx(1)
    assert stats.spearman(up.withColumn("y", -F.col("y")), [], "x", "y").first().rho == pytest.approx(-1)
    assert stats.spearman(up.withColumn("y", F.lit(1.0)), [], "x", "y").first().rho is None
    a = spark.createDataFrame([(0.1, False), (0.2, False), (0.3, False), (0.8, True), (0.9, True)], "s double, p boolean")
    assert stats.auroc(a, [], "s", "p").first().auroc == 1.0
    assert stats.auroc(a.where("p"), [], "s", "p").first().auroc is None
    r = random.Random(3)
    rows = [(r.choice([0.1, 0.2, 0.3, 0.4]), r.random() < 0.4) for _ in range(80)]
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    want = sum((x > y) + 0.5 * (x == y) for x in pos for y in neg) / len(pos) / len(neg)
    assert stats.auroc(spark.createDataFrame(rows, "s double, p boolean"), [], "s", "p").first().auroc == pytest.approx(want)


def test_panel_and_regression(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(6, 1)) * 3 + r.normal(size=(1, 4)) + r.normal(size=(6, 4)) * 0.2
    p = spark.createDataFrame([(i, j, float(v[i, j])) for i in range(6) for j in range(4)], "u int, r int, v double")
    s = stats.variance_shares(p, "u", "r", "v").first()
    assert sum(s) == pytest.approx(100) and s.unit_share > s.rep_share
    g = r.integers(0, 5, 60)
    x, w = r.normal(size=60), r.uniform(1, 3, 60)
    y = 2.5 * x + g + r.normal(size=60) * 0.1
    d = np.column_stack([x, *(g == k for k in range(5))])
    want = np.linalg.lstsq(d * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0]
    c = spark.createDataFrame([(int(a), float(b), float(e), float(f)) for a, b, e, f in zip(g, x, y, w)], "g int, x double, y double, w double")
    assert stats.fixed_effects(c, "g", "y", "x", "w").first().beta == pytest.approx(want)
    sr = stats.signed_ranks(spark.createDataFrame([(1.0,), (-2.0,), (3.0,), (0.0,), (3.0,)], "d double"), [], "d").first()
    assert (sr.n, sr.w_plus, sr.w_minus) == (4, 8.0, 2.0)


def test_special():
    assert special.normal_cdf(1.959963985) == pytest.approx(0.975)
    assert special.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.t_two_sided(0.359, 2) == pytest.approx(0.7538, abs=1e-3) and math.isnan(special.t_two_sided(1.0, 0))


def test_distributions(spark):
    d = spark.createDataFrame([([0.1, 0.7, 0.2], [0.1, 0.7, 0.2], [0.5, 0.25, 0.25])], "p array<double>, q array<double>, r array<double>")
    x = d.select(arrays.kl(F.col("p"), F.col("q")).alias("k"), arrays.overlap(F.col("p"), F.col("q")).alias("o"), arrays.overlap(F.col("p"), F.col("r")).alias("o2"), arrays.rank_of(F.col("p"), F.lit(2)).alias("rk"), arrays.argmax(F.col("p")).alias("am"), arrays.entropy(F.col("r")).alias("h"), arrays.top_k(F.col("p"), 2).alias("t")).first()
    assert x.k == pytest.approx(0) and x.o == pytest.approx(1) and x.o2 == pytest.approx(1 - 0.45) and (x.rk, x.am) == (2, 1)
    assert x.h == pytest.approx(1.0397207708) and [y.i for y in x.t] == [1, 2]
    k = spark.createDataFrame([([1, 2, 3],), ([3, 2, 1],), ([1],), ([],)], "o array<int>").select(arrays.kendall(F.col("o"))).collect()
    assert [r[0] for r in k] == [1.0, -1.0, 1.0, 1.0]
    top = spark.range(1).select(arrays.implied_top(F.lit(-(0.9 * math.log(0.9) + 0.1 * math.log(0.1))))).first()[0]
    assert top == pytest.approx(0.9)


def test_bins_and_classes(spark):
    e = [r[0] for r in spark.createDataFrame([(v,) for v in (0.0, 0.95, 0.99, 1.0, 1.2)], "v double").select(aggregates.edge_bin(F.col("v"), [0.0, 0.95, 0.99, 1.0])).collect()]
    assert e == [0, 1, 2, 2, None]
    b = [r[0] for r in spark.range(0, 45).select(classify.position_bucket(F.col("id"))).collect()]
    assert b[0] == "0" and b[9] == "2-9" and b[39] == "20-39" and b[44] == "40+"
    f = spark.createDataFrame([(0.01, 0.01, 0.0, 30), (0.5, 0.5, None, 90)], "a double, b double, i double, c int").select(classify.feasibility(*map(F.col, "abic"))).collect()
    assert len(f[0][0]) == 4 and f[1][0] == []
    t = [r[0] for r in spark.createDataFrame([("क", "क"), ("का", "क"), ("क", "ग"), ("क", "ह"), ("क", "x"), ("", "x")], "a string, b string").select(classify.confusion_tag(F.col("a"), F.col("b"))).collect()]
    assert t == ["identical", "same-base-matra-diff", "adjacent-codepoint", "both-devanagari", "dissimilar", "empty"]
    c = [r[0] for r in spark.createDataFrame([(2, 200.0, 1.0, 0.0), (2, 2.0, 1.0, 0.2), (2, 2.0, 1.0, 0.0), (1, 1.0, 1.0, 0.0), (2, 50.0, 1.0, 0.0)], "n int, a double, b double, g double").select(classify.curve_reading(*map(F.col, "nabg"))).collect()]
    assert c == ["a", "b", "modest", "insufficient", "undecided"]
    box = lambda k, x, y, w, h: (k, x, y, w, h)
    pages = [[box("form_field", 0.1, 0.1, 0.1, 0.1)], [box("text", 0.1, 0.1, 0.3, 0.5), box("text", 0.6, 0.1, 0.3, 0.5), box("table", 0.0, 0.0, 0.1, 0.1)], [box("margin", 0.0, 0.1, 0.1, 0.5)], [box("text", 0.95, 0.1, 0.05, 0.5)], [box("table", 0.1, 0.1, 0.3, 0.2)], [box("text", 0.1, 0.1, 0.8, 0.8)], []]
    d = spark.createDataFrame([(p,) for p in pages], "r array<struct<kind:string,x:double,y:double,width:double,height:double>>")
    assert [r[0] for r in d.select(classify.layout_category(F.col("r"))).collect()] == ["form", "two-column", "marginalia", "marginalia", "table-embedded", "single-column", "single-column"]


def test_alignment(spark):
    assert [(i, j) for i, j in alignment.aligned(["क", "ख"], ["क", "घ"])] == [(0, 0), (1, 1)]
    d = spark.createDataFrame([(1, ["a"], ["a", "b"]), (2, ["a", "b"], ["a", "c"]), (3, None, ["x"]), (4, [], [])], "i int, a array<string>, b array<string>")
    assert [tuple(r) for r in alignment.substitutions(d, "a", "b").collect()] == [(2, "b", "c", 1, 1)]


def test_joins(spark):
    d = spark.createDataFrame([(g, i) for g in "ab" for i in range(5)] + [("c", 9)], "g string, i int")
    p = joins.deranged(d, ["g"], [F.md5(F.col("i").cast("string"))], ["i"]).collect()
    assert len(p) == 10 and all(r.i != r.paired_i for r in p)
    cells = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.1, 2.0), (1, 9.0, 9.5)], "t int, x0 double, x1 double")
    heads = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0)], "t int, col int, x0 double, x1 double")
    assert sorted(r.bound for r in joins.bind_to_headers(cells, heads, ["t"]).collect()) == [0, 0, 1]
    b = spark.createDataFrame([([("B", 0.1, 0.5), ("R", 0.6, 0.11), ("L", 0.1, 0.1)],)], "b array<struct<id:string,x:double,y:double>>")
    assert b.select(joins.votes_order(F.col("b"))).first()[0] == ["L", "R", "B"]
    n = spark.createDataFrame([(["a", "b"],)], "t array<string>").select(joins.ngrams(F.col("t"), 2)).first()[0]
    assert [(x.ctx, x.tok) for x in n] == [("<BOS>", "a"), ("a", "b"), ("b", "<EOS>")]
    tr = spark.createDataFrame([(["a", "a", "a"],), (["a", "a", "b"],)], "t array<string>")
    sc = joins.ngram_scores(tr, spark.createDataFrame([(1, ["a", "b", "c"])], "id int, t array<string>"), "t", 2).collect()
    p = {r.pos: r.log_p for r in sc}
    assert p[0] == pytest.approx(math.log(2.01 / 2.04)) and p[1] == pytest.approx(math.log(1.01 / 5.04)) and p[2] == pytest.approx(math.log(0.01 / 1.04))
    with pytest.raises(ValueError):
        joins.assert_none(d, "rows")


def test_sampling(spark):
    assert sampling.seats({"a": 66, "b": 42, "c": 38, "d": 18, "e": 42, "f": 9}, 200) == {"a": 61, "b": 39, "c": 35, "d": 18, "e": 39, "f": 8}
    assert sampling.seats({"a": 3}, 9) == {"a": 3} and sum(sampling.seats({"a": 50, "b": 1, "c": 1}, 10, True).values()) == 10
    q = sampling.largest_remainder(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "g string, m double"), "g", "m", 10)
    assert {r.g: r.quota for r in q.collect()} == {"a": 3, "b": 3, "c": 4}
    d = spark.createDataFrame([("x", i, float(i)) for i in range(50)], "g string, i int, v double")
    a = sampling.hash_sample(d, ["g"], F.col("i"), 10)
    assert a.count() == 10 and {r.i for r in a.collect()} == {r.i for r in sampling.hash_sample(d.repartition(5), ["g"], F.col("i"), 10).collect()}
    for m in (sampling.bootstrap_means(d, ["g"], F.col("i"), "v", 60), sampling.bootstrap_means(d.repartition(7), ["g"], F.col("i"), "v", 60, "other")):
        i = sampling.interval(m, ["g"]).first()
        assert m.count() == 60 and i.lo < 24.5 < i.hi
    w = sampling.corpus_walk(spark.createDataFrame([("s", "a", "b", 5), ("s", "b", "a", 3)], "script string, a string, b string, n long"), spark.createDataFrame([("s", "a", 3), ("s", "b", 2)], "script string, glyph string, quota long"))
    assert sorted("".join(r.text for r in w.collect())) == list("aaabb")


def test_glyph_outcomes_of_whole_texts(spark, tmp_path):
    """Glyphs read right in a line that isn't right as a whole are counted."""
    from lipika.plans import registry

    lines = [("hindi", "कमल नयन", "कमल गयन"), ("hindi", "कमल", "कमल"), ("hindi", "मन", None), (None, "कम", "कम"), ("tamil", "மரம்", "மம்")]
    d = spark.createDataFrame([(k, "e", lang, str(k), "v", "GENUINE", "x", gt, hyp, 0, None) for k, (lang, gt, hyp) in enumerate(lines)], "row_no long, engine string, language string, image_id string, variant string, bucket string, taxonomy_label string, ground_truth string, predicted string, batch_no int, recorded_at timestamp")
    d.write.parquet(f"{tmp_path}/error_taxonomy.parquet")
    got = {(r.language, r.ch): (r.total, r.correct) for r in registry.queries()["d28_glyph_outcomes"](spark, str(tmp_path)).collect()}
    assert got == {("hindi", "क"): (2, 2), ("hindi", "म"): (3, 2), ("hindi", "ल"): (2, 2), ("hindi", "न"): (3, 1), ("hindi", "य"): (1, 1), ("tamil", "ம"): (1, 1), ("tamil", "ர"): (1, 0), ("tamil", "ம்"): (1, 1)}


def test_alignment_in_lockstep():
    r = random.Random(3)
    text = lambda: [r.choice("abcd") for _ in range(r.randrange(12))]
    pairs = [(text(), text()) for _ in range(500)]
    assert alignment.aligned_many(pairs) == [alignment.aligned(a, b) for a, b in pairs]


def test_confusions_of_whole_texts(spark, tmp_path):
    """Confusions after the first code point are counted."""
    from lipika.plans import registry

    lines = [("hindi", "कमल", "कनल"), ("hindi", "मकम", "मकन"), ("hindi", "कम", "क"), (None, "लम", "लन"), ("hindi", "लक", None)]
    d = spark.createDataFrame([(k, "e", lang, str(k), "v", "GENUINE", "x", gt, hyp, 0, None) for k, (lang, gt, hyp) in enumerate(lines)], "row_no long, engine string, language string, image_id string, variant string, bucket string, taxonomy_label string, ground_truth string, predicted string, batch_no int, recorded_at timestamp")
    d.write.parquet(f"{tmp_path}/error_taxonomy.parquet")
    run = lambda name: sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect())
    assert run("d24_confusion_edges") == [("म", "न", 3, round(8 / 3, 6), "कनल")]
    assert run("f1_top_confusions") == [("म", "न", 3)]
    assert run("b14_confusion_tag") == [("both-devanagari", 3), ("empty", 3), ("identical", 6)]
    assert run("c16_exposure_accuracy") == [("hindi", 3, 0.5)]


def test_hash_orders_are_those_of_md5():
    md5 = lambda d, k: hashlib.md5(f"perm|{d}|{k + 1}".encode()).hexdigest()
    for n, first, last in ((1, 0, 3), (12, 95, 1003), (1234, 9, 12), (120_000, 10_000, 10_002)):
        order = digests.hash_orders("perm", first, last, n)
        for d in range(first, last):
            assert order[d - first].tolist() == sorted(range(n), key=lambda k: (md5(d, k), k))
    by_32_bits = [sorted(range(n), key=lambda k: md5(d, k)[:8]) for d in (10_000, 10_001)]
    assert order.tolist() != by_32_bits  # whole digests had to decide
    with pytest.raises(ValueError):
        digests.hash_orders("s" * 60, 0, 1, 3)


def _shuffled_records(spark, run):
    """What ``run`` returns, and the rows that its stages wrote for shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = lambda: store.stageList(None, False, False, none, jvm.java.util.ArrayList())
    last = max((stages().apply(i).stageId() for i in range(stages().size())), default=-1)
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = stages()
    return out, sum(x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size())) if x.stageId() > last)


def test_permuted_spearman_moves_units_not_draws(spark, monkeypatch):
    r, draws = random.Random(3), 400
    groups = {"a": [(r.randrange(6), r.random()) for _ in range(130)], "b": [(i, i + r.randrange(9)) for i in range(15)], "few": [(1, 2), (2, 1)], "same": [(1, i) for i in range(9)]}
    rows = [(g, i, float(x), float(y)) for g, units in groups.items() for i, (x, y) in enumerate(units)]
    want = {"few": (2, -1.0, None), "same": (9, None, None)}
    for g in "ab":
        x, y = (pd.Series(v).rank().to_numpy() for v in zip(*groups[g]))
        rho, n = np.corrcoef(x, y)[0, 1], len(x)
        orders = [sorted(range(n), key=lambda i: hashlib.md5(f"perm|{d}|{i + 1}".encode()).hexdigest()) for d in range(draws)]
        want[g] = (n, rho, (1 + sum(abs(np.corrcoef(x[o], y)[0, 1]) >= abs(rho) - 1e-12 for o in orders)) / (draws + 1))
    units = spark.createDataFrame(rows + [("a", 999, None, 1.0)], "g string, i long, x double, y double").repartition(3)
    run = lambda: {t.g: (t.n, t.rho, t.p) for t in sampling.permuted_spearman(units, ["g"], F.col("i"), "x", "y", draws).collect()}
    same = lambda got: got.keys() == want.keys() and all(a == b if a is None or b is None else a == pytest.approx(b) for g in want for a, b in zip(got[g], want[g]))
    monkeypatch.setattr(sampling, "SHUFFLED", 10_000)  # six parts of a's draws
    got, moved = _shuffled_records(spark, run)
    assert same(got) and moved < 40 * len(rows)
    monkeypatch.setattr(sampling, "HELD", 50)  # a is shuffled by Spark
    got, by_draw = _shuffled_records(spark, run)
    assert same(got) and by_draw > draws * 130
