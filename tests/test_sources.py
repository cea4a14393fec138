import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lipika.operators.engines import run_engine
from lipika.sources import records, reports
from lipika.streaming import records as streams


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))


def test_lines_and_torn_tail(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    write(p, ['{"id": "1", "text": "क"}', "", '{"id": "2", "text": "x"}', '{"id": "3", "te'])
    assert [r.id for r in records.read_checked_tail(spark, p, "id string, text string").orderBy("id").collect()] == ["1", "2"]
    write(p, ['{"id": "1"}', '{"id": broken', '{"id": "3"}'])
    with pytest.raises(Exception, match="broken line"):
        records.read_checked_tail(spark, p, "id string").collect()
    assert records.read_lines(spark, str(tmp_path / "none.jsonl"), "ground_truth", missing_ok=True).count() == 0
    write(str(tmp_path / "doc.json"), [json.dumps({"records": [{"confidence": 0.5, "correct": True}], "buckets": []})])
    assert records.read_records(spark, str(tmp_path / "doc.json"), "confidence double, correct boolean").collect()[0].correct


def test_partitions_append_and_files(spark, tmp_path):
    for e in ("surya", "tesseract"):
        write(str(tmp_path / f"pred/{e}/hindi.jsonl"), ['{"id": "1"}'])
    d = records.read_partitions(spark, str(tmp_path / "pred"), "id string", r"/([^/]+)/([^/]+)\.jsonl$", ["engine", "language"])
    assert {(r.engine, r.language) for r in d.collect()} == {("surya", "hindi"), ("tesseract", "hindi")}
    assert records.read_partitions(spark, str(tmp_path / "no"), "id string", "x", ["engine"]).count() == 0
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    records.append_new(rows, out, ["k"])
    records.append_new(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), out, ["k"])
    assert sorted(r.k for r in records.read_lines(spark, out, "k int").collect()) == [1, 2, 3]
    assert records.list_files(spark, str(tmp_path / "pred")).count() == 2 and records.content_keys(spark, str(tmp_path / "pred")).select("key").distinct().count() == 1
    old, new = str(tmp_path / "res/a.json"), str(tmp_path / "ckpt/a.json")
    write(old, ["{}"])
    time.sleep(1.1)
    write(new, ["{}"])
    f = lambda p: records.list_files(spark, str(tmp_path / p))
    state = records.freshness(f("res"), f("ckpt"), F.regexp_extract("path", r"([^/]+)\.json$", 1)).first().state
    assert state == "STALE" and records.freshness(f("res"), f("ckpt").limit(0), F.lit("a")).first().state == "MISSING"


def test_reports(spark, tmp_path):
    assert reports.markdown(spark.createDataFrame([(1, 0.5, None)], "a int, b double, c string")) == "| a | b | c |\n|---|---|---|\n| 1 | 0.5000 |  |\n"
    write(str(tmp_path / "p/x.jsonl"), ["{}"])
    assert reports.zip_folder(str(tmp_path / "p"), str(tmp_path / "z.zip")) == 1
    reports.save_progress(str(tmp_path / "c.json"), {"page": 3})
    assert reports.load_progress(str(tmp_path / "c.json")) == {"page": 3} and reports.load_progress(str(tmp_path / "d.json")) == {}


def test_engine_isolation(spark):
    def engine(path, language):
        if path == "bad":
            raise ValueError("no")
        if path == "hang":
            time.sleep(60)
        if path == "die":
            os._exit(3)
        seen.append(path)
        return {"predicted_text": path.upper(), "confidence": float(len(seen))}

    seen = []
    d = spark.createDataFrame([("a", "hi", 1), ("bad", "hi", 2), ("hang", "hi", 3), ("b", "hi", 4), ("die", "hi", 5), ("c", "hi", 6), ("d", "hi", 7)], "image_path string, language string, k int")
    t = time.time()
    rows = run_engine(d.coalesce(1), engine, 2.0).collect()
    got = {r.k: (r.predicted_text, r.skipped_reason) for r in rows}
    assert {r.k: r.confidence for r in rows if r.confidence} == {1: 1.0, 4: 1.0, 6: 1.0, 7: 2.0}  # one process, replaced when it hangs or dies
    assert got == {1: ("A", None), 2: (None, "ValueError: no"), 3: (None, "timeout"), 4: ("B", None), 5: (None, "died"), 6: ("C", None), 7: ("D", None)} and time.time() - t < 30


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    row = lambda i, d: json.dumps({"k": i, "at": f"2025-01-{d:02d}T00:00:00Z", "v": i})
    write(f"{src}/1.json", [row(1, 1), row(2, 1), row(1, 1)])
    s = lambda: streams.stream_lines(spark, src, "k int, at timestamp, v int")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    streams.append_once(s(), out, ["k"], ck).awaitTermination()
    write(f"{src}/2.json", [row(2, 2), row(3, 2)])
    streams.append_once(s(), out, ["k"], ck).awaitTermination()
    assert sorted(r.k for r in records.read_lines(spark, out, "k int").collect()) == [1, 2, 3]
    streams.to_memory(streams.running_counts(s(), ["k"]), "counts").awaitTermination()
    assert {r.k: r.n for r in spark.table("counts").collect()} == {1: 2, 2: 2, 3: 1}
    streams.to_memory(streams.windowed_means(s(), "at", [], F.col("v")), "means").awaitTermination()
    assert sorted((r.n, r.mean) for r in spark.table("means").collect()) == [(2, 2.5), (3, pytest.approx(4 / 3))]
    streams.to_memory(streams.first_by_key(s(), ["k"], "at"), "firsts", "append").awaitTermination()
    assert sorted(r.k for r in spark.table("firsts").collect()) == [1, 2, 3]
