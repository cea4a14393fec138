from lipika.llm import stable_sample as s
from lipika.session import shared_path

TAX = "language string, image_id string, batch_no int, Image_Id string"
PROBE = "script string, condition string, image_id string, image_path string, value string"
PRIOR = "language string, image_id string, first_seen string"


def test_growth_keeps_what_was_selected(spark):
    reg = s.Registry(spark, shared_path(spark, "reg"))
    data = [("hindi", str(i), i % 12, "x") for i in range(600)]
    reg.raise_threshold(0.2)
    before = set()
    for batch in range(12):
        df = spark.createDataFrame([d for d in data if d[2] <= batch], TAX)
        reg.insert(s.taxonomy_images(df), f"b{batch}")
        now = {tuple(r)[:2] for r in reg.select().collect()}
        assert before <= now
        before = now
    assert reg.values().count() == 600 and 80 < len(before) < 160
    reg.raise_threshold(0.1)
    assert reg.threshold() == 0.2
    reg.raise_threshold(0.4)
    assert before <= {tuple(r)[:2] for r in reg.select().collect()}
    other = s.Registry(spark, shared_path(spark, "reg"))
    other.raise_threshold(0.4)
    other.insert(s.taxonomy_images(spark.createDataFrame(data[::-1], TAX).repartition(5)), "all")
    assert {tuple(r)[:3] for r in other.select().collect()} == {tuple(r)[:3] for r in reg.select().collect()}


def test_prior_images_that_still_occur(spark):
    tax = spark.createDataFrame([("Hindi ", "007", 1, None), ("bengali", "7", 1, None), (None, "8", 1, None), ("hindi", None, 2, None)], TAX)
    probe = spark.createDataFrame([("hindi", "real", None, "data/raw/hindi/images/12_plain.png", "v"), ("blank", "blank", "blank_01", "x", "v"), ("kashmiri", "REAL", " 05", "q", "v")], PROBE)
    prior = spark.createDataFrame([("HINDI", " 7", "a"), ("hindi", "0012", "a"), ("hindi", "12", "b"), ("hindi", "99", "a"), ("kashmiri", "5", "a"), (None, "7", "a")], PRIOR)
    assert {tuple(r) for r in s.kept(tax, probe, prior).collect()} == {("hindi", "7"), ("hindi", "12"), ("kashmiri", "5")}
    assert {("hindi", "7"), ("hindi", "12")} <= {tuple(r)[:2] for r in s.draw(tax, probe, prior, 1e-6).collect()}


def test_empty_tables(spark):
    none = [spark.createDataFrame([], x) for x in (TAX, PROBE, PRIOR)]
    assert s.draw(*none).count() == 0


def test_registry_outlives_the_call(spark):
    """A second draw, of grown tables and by another session's object, finds the values of the first; a lower value counts."""
    path = shared_path(spark, "reg")
    tax = lambda n: spark.createDataFrame([("hindi", str(i), i % 12, "x") for i in range(n)], TAX)
    none, probe = spark.createDataFrame([], PRIOR), spark.createDataFrame([], PROBE)
    first = {tuple(r) for r in s.draw(tax(300), probe, none, 0.2, s.Registry(spark, path), "a").collect()}
    second = {tuple(r) for r in s.draw(tax(500), probe, none, 0.2, s.Registry(spark, path), "b").collect()}
    assert first < second and {r[3] for r in first} == {"a"} and {r[3] for r in second - first} == {"b"}
    left = next(str(i) for i in range(300) if str(i) not in {r[1] for r in first})
    prior = spark.createDataFrame([("hindi", left, "x"), ("hindi", next(iter(first))[1], "x")], PRIOR)
    third = {tuple(r)[:2] for r in s.draw(tax(500), probe, prior, 0.2, s.Registry(spark, path)).collect()}
    assert third == {r[:2] for r in second} | {("hindi", left)}
    assert {r[1] for r in s.kept(tax(500), probe, prior, 0.2, s.Registry(spark, path)).collect()} == {left, next(iter(first))[1]}
    reg = s.Registry(spark, path)
    reg.values().limit(50).write.mode("append").parquet(f"{path}/values")  # an insert at the same time
    assert reg.values().count() == 500


def test_two_arrivals(spark):
    tax = spark.createDataFrame([("hindi", str(i), i % 12 if i % 7 else None, "x") for i in range(400)], TAX)
    none = spark.createDataFrame([], PROBE), spark.createDataFrame([], PRIOR)
    got = {(r.image_id, r.first_seen) for r in s.grown(tax, *none, s.Registry(spark, shared_path(spark, "reg")), 6, 0.3).collect()}
    assert {i for i, _ in got} == {r.image_id for r in s.draw(tax, *none, 0.3).collect()}
    assert all((seen == "earlier") == (int(i) % 7 > 0 and int(i) % 12 <= 6) for i, seen in got)
