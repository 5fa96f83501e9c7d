import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vector as V
from tessera.operators import batching as B
from tessera.operators import compare as C
from tessera.operators import ngram as N
from tessera.operators import tree as R
from tessera.streaming import streams as X


def test_compare_weighs_by_repeats(spark):
    rows = spark.createDataFrame([("x", "p", 1.0), ("x", "p", 3.0), ("x", "q", 10.0), (None, "p", 99.0)], "k string, g string, v double")
    other = spark.createDataFrame([("x", "p", 2.0), ("x", "q", 4.0), ("x", "q", 6.0), ("x", "q", 8.0), (None, "p", 1.0)], "k string, g string, v double")
    got = C.compare_builds(rows, other, ["k", "g"], ["k"], ["v"]).collect()
    plain = [(a.v, b.v) for a in rows.collect() for b in other.collect() if a.k is not None and (a.k, a.g) == (b.k, b.g)]
    assert len(got) == 1 and got[0].avg_v_base == pytest.approx(sum(a for a, _ in plain) / len(plain)) and got[0].avg_v_other == pytest.approx(sum(b for _, b in plain) / len(plain))


def test_auto_show(spark):
    df = spark.createDataFrame([(1, "a", None, 5), (2, "a", None, None)], "x long, same string, none string, some long")
    assert C.auto_show(df).columns == ["x", "some"]


def test_zip_needs_equal_lengths(spark):
    a = spark.range(10)
    with pytest.raises(ValueError):
        C.zipped(a, a.limit(9).select(F.col("id").alias("j")), ["id"], ["j"])
    assert sorted(r.pos for r in C.numbered(spark.range(1000).withColumn("k", F.col("id") * 7 % 1000), ["k"]).collect()) == list(range(1000))


def test_chunks(spark):
    text = ["a" * 70 + "\n" + "b" * 10 + "\n" + "c" * 60 + "\ntail", "short", "", "x" * 65]
    got = [r.c for r in spark.createDataFrame([(t,) for t in text], "t string").select(T.chunks(F.col("t")).alias("c")).collect()]
    assert ["".join(c) for c in got] == text and [len(c) for c in got] == [2, 1, 0, 1]


def test_word_confidence(spark):
    # One word of seven tokens; expected least and mean confidence. Fixed values.
    lp = [-0.0019, -0.2585, -0.7930, -0.0000, -0.2206, -0.0007, -0.0002]
    rows = [(1, i, "Ġ" * (i == 0) + f"t{i}", False, x) for i, x in enumerate(lp)] + [(1, 7, "<eos>", True, -5.0), (1, 8, "next", False, -0.1)]
    got = T.word_confidence(spark.createDataFrame(rows, "seq_id long, pos long, piece string, is_special boolean, logprob double")).orderBy("word_no").collect()
    assert [(r.word, round(r.min_conf, 4), round(r.geo_conf, 4), r.n_tokens, r.is_low) for r in got] == [("t0t1t2t3t4t5t6", 0.4525, 0.8335, 7, True), ("next", 0.9048, 0.9048, 1, False)]


def test_ngram_merge_is_the_count_of_the_union(spark):
    rows = [(s, i, f"w{(s * i) % 4}") for s in range(6) for i in range(30)]
    t = spark.createDataFrame(rows, "seq_id long, pos long, token string")
    one = N.counts(t)
    two = N.merged(N.counts(t.where("seq_id < 3")), N.counts(t.where("seq_id >= 3")))
    assert one.exceptAll(two).count() == 0 == two.exceptAll(one).count()


def test_tree(spark):
    # root - 1 - 2 - {3, 6}, root - 4 - 5
    rows = [("r", None, 0, "system"), ("1", "r", 1, "user"), ("2", "1", 2, "assistant"), ("3", "2", 3, "user"), ("6", "2", 6, "user"), ("4", "r", 4, "user"), ("5", "4", 5, "assistant")]
    m = spark.createDataFrame([(i, 1, p, t, r, f"m{i}") for i, p, t, r in rows], "id string, convId long, parent string, timestamp long, role string, content string")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(R.path(spark, m, "3")) == ["r", "1", "2", "3"] and ids(R.path(spark, m, "?", 1)) == ["r", "1", "2", "6"]
    assert {r.start: r.leaf for r in R.leaf_of(spark, m, m.select("id")).collect()} == {"r": "5", "1": "6", "2": "6", "3": "3", "6": "6", "4": "5", "5": "5"}
    assert sorted(ids(R.descendants(spark, m, m.where("id = '1'").select("id")))) == ["2", "3", "6"]
    assert sorted(ids(R.delete_cascading(spark, m, m.where("id = '2'").select("id")))) == ["1", "4", "5", "r"]
    up = {r.id: r.parent for r in R.delete_reparenting(m, m.where("id = '2'").select("id")).collect()}
    assert up["3"] == "1" == up["6"]
    assert {r.id: r.parent for r in R.fork(spark, m, "3", 9).collect()}["3@9"] == "2@9"


def test_batches(spark):
    rows = [(0, s, p) for s, n in ((0, 5), (1, 3)) for p in range(n)]
    got = B.split_equal(spark.createDataFrame(rows, "batch long, seq long, pos long"), 4).collect()
    by = {}
    for r in got:
        by.setdefault(r.ubatch, []).append(r.seq)
    assert [sorted(by[k]) for k in sorted(by)] == [[0, 0, 1, 1], [0, 1], [0, 0]]
    packed = B.pack(spark.createDataFrame([(0, i, v) for i, v in enumerate((5, 5, 1, 20, 2))], "k long, i long, v long"), "v", 10, 2, "k", "i").collect()
    assert [r.batch for r in sorted(packed, key=lambda r: r.i)] == [0, 0, 1, 2, 3]


def test_queue_over_batches(spark, tmp_path):
    rows = [(1, i, 10.0, i * 4.0) for i in range(6)]
    df = spark.createDataFrame(rows, "server long, task_id long, seconds double, at double").withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).drop("at")
    for i in range(2):
        df.where(f"task_id >= {3 * i} AND task_id < {3 * i + 3}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/q")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/q")
    got = {r.task_id: r.waited for r in X.run(X.slot_queue(stream, 1)).collect()}
    assert got == {i: i * 6.0 for i in range(6)}


def _tree(spark, rows):
    return spark.createDataFrame([(i, 1, p, t, "user", "") for t, (i, p) in enumerate(rows)], "id string, convId long, parent string, timestamp long, role string, content string")


def test_deep_tree(spark):
    n = 10_000
    m = _tree(spark, [(f"m{i}", f"m{i - 1}" if i else None) for i in range(n)]).cache()
    got = R.path(spark, m, f"m{n - 1}").select("id").collect()
    assert [r.id for r in got] == [f"m{i}" for i in range(n)]
    assert R.paths(m, spark).where("up = 9999 and id = 'm0'").count() == 1
    assert {r.leaf for r in R.leaf_of(spark, m, m.select("id")).select("leaf").distinct().collect()} == {f"m{n - 1}"}
    below = R.descendants(spark, m, m.where("id = 'm5'").select("id"))
    assert below.count() == n - 6 and below.agg(F.max("depth")).first()[0] == n - 6


def test_odd_trees(spark):
    m = _tree(spark, [("it's", None), ("b", "it's"), ("c", "gone"), ("it's", None)])
    assert [r.id for r in R.path(spark, m.distinct(), "it's").collect()][0] == "it's"
    assert [r.id for r in R.path(spark, m.where("id <> \"it's\""), "c").collect()] == ["c"]
    assert R.path(spark, m.limit(0), "x", 1).count() == 0 == R.paths(m.limit(0), spark).count()
    assert R.path(spark, m, "nowhere").count() == 0
    ring = _tree(spark, [("d", "c"), ("a", "c"), ("b", "a"), ("c", "b")])
    for run in (lambda: R.paths(ring, spark), lambda: R.leaf_of(spark, ring, ring.select("id")), lambda: R.path(spark, ring, "d")):
        with pytest.raises(R.CycleError):
            run().collect()


def test_reachable_over_levels_and_cycles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 0), (0, 30), (5, None)], "child long, parent long")
    got = {r.node: r.depth for r in C.reachable(spark, edges, 0).collect()}
    assert got == {i: min(i, i - 29 if i >= 30 else i) for i in range(41)}


def test_escapes_take_each_mark_once(spark):
    text = ["a\x01b", r"\\n", r"\\\n", "\\", r"\x41\x4", r"\q", "", None, r"\xff"]
    got = [r.e for r in spark.createDataFrame([(x,) for x in text], "t string").select(T.process_escapes(F.col("t")).alias("e")).collect()]
    assert got == ["a\x01b", r"\n", "\\\n", "\\", r"A\x4", r"\q", "", None, r"\xff"]


def test_override_reads_any_bigint(spark):
    rows = spark.createDataFrame([("k=int:1234567890123",), ("k=int:-5",), ("k=int:1.5",), ("k=int:99999999999999999999",)], "t string")
    assert [r.o.as_int for r in rows.select(T.override(F.col("t")).alias("o")).collect()] == [1234567890123, -5, None, None]


def test_histogram_with_an_outlier(spark):
    got = C.histogram(spark.createDataFrame([(0.5,), (25_000.2,), (25_000.4,)], "v double"), "v")
    assert got.count() == 25_001 and {r.bin: r.n for r in got.where("n > 0").collect()} == {0: 1, 25_000: 2}


def test_packing_goes_by_key(spark):
    rows = [(k, i, 4) for k in (None, 1, 2) for i in range(10)]
    got = B.pack(spark.createDataFrame(rows, "k long, i long, v long"), "v", 12, 9, "k", "i").collect()
    assert sorted((str(r.k), r.i, r.batch) for r in got) == sorted((str(k), i, i // 3) for k, i, _ in rows)


def test_gathered_state_ends(spark, tmp_path):
    parts = [(1, 0, "partial", "a", 0), (1, 1, "final", "b", 1), (2, 0, "partial", "never", 0), (3, 0, "final", "c", 100_000)]
    for i, p in enumerate([*parts, (4, 0, "final", "d", 200_000)]):
        spark.createDataFrame([p], "task_id long, idx long, kind string, text string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s").coalesce(1).write.parquet(f"{tmp_path}/p{i}/x")
    stream = spark.readStream.schema("task_id long, idx long, kind string, text string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    assert {r.task_id: r.text for r in X.run(X.gathered(stream)).collect()} == {1: "ab", 3: "c", 4: "d"}


def test_erf(spark):
    xs = [0.0, -0.0, 1e-300, 0.1, -0.5, 1.0, 2.9999, 3.0, -3.0001, 4.5, 6.0, -30.0, float("inf"), *(i / 37 - 4 for i in range(300))]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", V.erf(F.col("x")).alias("y")).collect()
    assert all(r.y == pytest.approx(math.erf(r.x), abs=1e-13) for r in got)
    rows = spark.createDataFrame([(float("nan"),), (None,)], "x double").select(V.erf(F.col("x")).alias("y")).collect()
    assert math.isnan(rows[0].y) and rows[1].y is None
