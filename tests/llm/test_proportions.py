import random

import numpy as np
import pandas as pd

from lipika.llm import proportions as P
from lipika.llm.proportions import ProportionalSample, feasible, records

SCHEMA = "row_no long, engine string, language string, image_id string, variant string, extra string, Engine string"
TARGETS = "target_id int, plan_name string, plan_size long, engine string, language string, variant string, target_share double, min_rows int"


def rows(n=600, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        e = r.choice(["tesseract", "Tesseract ", None, "surya", "\tSURYA"])
        lang = r.choice(["hindi", "HINDI", "bengali", None, ""])
        out.append((i, e, lang, r.choice(["1", "001", " 1 ", str(r.randrange(90))]), r.choice(["plain", "Plain\t", "degraded", None]), "x", "clash"))
    return out


def key(r):
    lab = lambda x: (x or "").strip().lower() or None
    img = "".join((r[3] or "").split())
    return lab(r[1]) or "tesseract", lab(r[2]), img.lstrip("0") or img[:1] or None, lab(r[4])


def test_records_against_brute_force(spark):
    data = rows()
    got = {(x.engine, x.language, x.image_id, x.variant): x.row_no for x in records(spark.createDataFrame(data, SCHEMA)).collect()}
    want = {}
    for r in data:
        want[key(r)] = min(want.get(key(r), 10**9), r[0])
    assert got == want


def test_sample_meets_quotas_and_is_stable(spark):
    data = rows(1500)
    targets = [(1, "a", 60, "tesseract", None, None, 0.7, 0), (2, "a", 60, "surya", None, None, 0.3, 0), (3, "b", 40, None, "hindi", "plain", 0.9, 5), (4, "b", 40, None, "sindhi", None, 0.1, 9)]
    t = spark.createDataFrame(targets, TARGETS)
    op = ProportionalSample(spark.createDataFrame(data, SCHEMA), t, bins=16)
    report = {r.target_id: r for r in op.report().collect()}
    assert report[4].available == 0 and not report[4].met and report[4].wanted == 9
    assert sum(report[i].quota for i in (1, 2)) == 60
    drawn = op.sample().collect()
    n = pd.Series([d.target_id for d in drawn]).value_counts().to_dict()
    assert n == {i: r.quota for i, r in report.items() if r.quota}
    assert len({(d.plan_name, d.engine, d.language, d.image_id, d.variant) for d in drawn}) == len(drawn)
    again = ProportionalSample(spark.createDataFrame(data[::-1], SCHEMA).repartition(7), t, bins=64)
    assert {tuple(x) for x in again.sample().collect()} == {tuple(x) for x in drawn}
    assert {r.target_id for r in op.unmet().collect()} == {i for i, r in report.items() if not r.met} >= {4}


def test_empty_tables(spark):
    none, t = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a", 10, None, None, None, 1.0, 2)], TARGETS)
    op = ProportionalSample(none, t)
    assert [r.target_id for r in op.unmet().collect()] == [1] and op.sample().count() == 0
    assert ProportionalSample(spark.createDataFrame(rows(20), SCHEMA), t.limit(0)).report().count() == 0


def test_feasible_shares_out_what_is_missing():
    p = pd.DataFrame({"target_id": [1, 2, 3], "plan_size": 100, "min_rows": 0, "target_share": [0.5, 0.3, 0.2], "wanted": [50, 30, 20], "available": [10, 500, 500]})
    q = feasible(p).set_index("target_id").quota
    assert q[1] == 10 and q.sum() == 100 and abs(q[2] / q[3] - 1.5) < 0.1


def plan(size, rows):
    return feasible(pd.DataFrame([{"target_id": i, "plan_size": size, "target_share": s, "min_rows": m, "wanted": max(m, round((s or 0) * size)), "available": a} for i, (s, m, a) in enumerate(rows)])).quota.tolist()


def test_floors_do_not_enlarge_the_plan():
    assert plan(100, [(0.99, 10, 500), (0.01, 10, 500)]) == [90, 10]
    assert plan(10, [(0.5, 8, 100), (0.5, 8, 100)]) == [8, 8] and plan(100, [(None, 5, 50), (1.0, 0, 50)]) == [5, 50]
    assert plan(100, [(0.333333, 0, 1000)] * 3) == [34, 33, 33] and plan(0, [(1.0, 0, 50)]) == [0]
    r = np.random.default_rng(1)
    for _ in range(500):
        size, rows = int(r.integers(0, 500)), [(s, int(r.integers(0, 30)) * int(r.random() < 0.4), int(r.integers(0, 300))) for s in r.dirichlet(np.ones(r.integers(1, 9)) / 2).round(6)]
        q, lo, hi = plan(size, rows), [min(m, a) for _, m, a in rows], [a if s > 0 else min(m, a) for s, m, a in rows]
        assert all(a <= x <= b for a, x, b in zip(lo, q, hi)) and sum(q) == min(max(size, sum(lo)), sum(hi))


def test_dense_bins_are_divided(spark):
    """A bin that holds too many records to be ranked at once gives the same sample."""
    data, t = rows(3000, 4), spark.createDataFrame([(1, "a", 300, None, None, None, 1.0, 0), (2, "b", 120, None, "hindi", None, 0.5, 0), (3, "b", 120, None, "bengali", None, 0.5, 0), (4, "c", 10**6, "surya", None, None, 1.0, 0)], TARGETS)
    want = {tuple(x) for x in ProportionalSample(spark.createDataFrame(data, SCHEMA), t).sample().collect()}
    P.EDGE, kept = 3, P.EDGE
    try:
        got = [tuple(x) for x in ProportionalSample(spark.createDataFrame(data, SCHEMA).repartition(3), t, bins=2).sample().collect()]
    finally:
        P.EDGE = kept
    assert set(got) == want and len(got) == len(want)


def test_categories_under_every_subset_of_columns(spark):
    data = rows(400, 9)
    wish = [(i, "p", 10, e, l, v, 0.1, 0) for i, (e, l, v) in enumerate((e, l, v) for e in (None, "Surya", "tesseract") for l in (None, " hindi", "none") for v in (None, "PLAIN"))]
    got = {r.target_id: r.available for r in ProportionalSample(spark.createDataFrame(data, SCHEMA), spark.createDataFrame(wish, TARGETS)).report().collect()}
    seen = {key(r) for r in data}
    for i, _, _, e, l, v, *_ in wish:
        assert got[i] == sum((e is None or k[0] == e.lower()) and (l is None or k[1] == l.strip()) and (v is None or k[3] == v.lower()) for k in seen)
