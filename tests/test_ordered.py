"""Ordered and as-of work: keys cut into chunks must give what whole keys give."""

import random

import pytest
from pyspark.sql import functions as F

from parcelspan.operators.ordered import Wanted, annotate, with_chunks
from parcelspan.operators.temporal import asof_join, inside_intervals, resample_track, sessions

R = random.Random(5)


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows and more have one key; keys and values may be NULL."""
    data, t = [], 0
    for i in range(900):
        t += R.choice([1, 1, 2, 40])
        key = "hot" if i % 5 < 2 else R.choice(["a", "b", None, "c"])
        data.append((key, t, i, R.choice([None, 1, 2, 3]), R.random() < 0.4))
    return spark.createDataFrame(data, "k string, t bigint, id bigint, v bigint, on boolean").persist()


def both(build):
    small, whole = sorted(map(str, build(20).collect())), sorted(map(str, build(10**9).collect()))
    assert small == whole and small


def test_chunks_split_hot_keys_wherever_their_rows_lie(spark):
    """One bad clock, equal times and ids that share a long beginning: no chunk holds much more than it should."""
    span = lambda: spark.range(20_000)
    bad_clock = span().selectExpr("'a' AS k", "id AS t", "id").union(spark.sql("SELECT 'b', 1000000000000, 5L"))
    equal = span().selectExpr("'a' AS k", "7L AS t", "id")
    names = span().selectExpr("'a' AS k", "concat('VEHICLE-0000-', lpad(id, 9, '0')) AS t", "id")
    for df in (bad_clock, equal, names):
        rows = with_chunks(df, ["k"], ["t", "id"], 1000)
        assert rows.count() == df.count()
        sizes = [r["count"] for r in rows.groupBy("k", "_chunk").count().collect()]
        assert max(sizes) <= 1000 and len(sizes) > 20
        along = rows.groupBy("k", "_chunk").agg(F.min(F.struct("t", "id")).alias("a"), F.max(F.struct("t", "id")).alias("b")).orderBy("k", "_chunk").collect()
        assert all(x["b"] < y["a"] for x, y in zip(along, along[1:], strict=False) if x["k"] == y["k"])


def test_annotate(rows):
    spec = Wanted(
        previous={"p": F.col("id"), "pv": F.col("v")}, following={"n": F.col("id")}, last_known={"l": F.col("v")},
        running_sum={"s": F.col("v")}, row_number="r",
    )
    both(lambda m: annotate(rows, ["k"], ["t", "id"], spec, m).select("id", "p", "pv", "n", "l", "s", "r"))


def test_asof(rows, spark):
    right = rows.where("v = 1").select("k", F.col("t").alias("rt"), F.col("id").alias("rid"))
    both(lambda m: asof_join(rows.select("k", "t", "id"), right, ["k"], "t", "rt", ["rid", "rt"], m))
    seen = {(r["k"], r["t"], r["id"]): r["rid"] for r in asof_join(rows.select("k", "t", "id"), right, ["k"], "t", "rt", ["rid"], 20).collect()}
    held = [(r["k"], r["rt"], r["rid"]) for r in right.collect()]
    for (k, t, _), rid in seen.items():
        best = max(((rt, x) for kk, rt, x in held if kk == k and rt <= t), default=(None, None))
        assert rid == best[1]


def test_intervals(rows):
    spans = rows.where("on").select("k", F.col("t").alias("a"), (F.col("t") + F.col("id") % 50).alias("b"))
    points = rows.select("k", "t", "id")
    both(lambda m: inside_intervals(points, spans, ["k"], "t", "a", "b", "inside", m))
    held = [(r["k"], r["a"], r["b"]) for r in spans.collect()]
    for r in inside_intervals(points, spans, ["k"], "t", "a", "b", "inside", 20).collect():
        assert r["inside"] == any(k == r["k"] and a <= r["t"] < b for k, a, b in held)


def test_resample(rows, spark):
    track = rows.where("k IS NOT NULL").groupBy("k", "t").agg(F.max("id").cast("double").alias("d"))
    ticks = spark.range(0, 12000, 60).withColumnRenamed("id", "t").join(track.select("k").distinct())
    both(lambda m: resample_track(ticks, track, ["k"], "t", ["d"], m).select("k", "t", F.round("d", 6).alias("d")))
    frames = {}
    for r in track.collect():
        frames.setdefault(r["k"], []).append((r["t"], r["d"]))
    for r in resample_track(ticks, track, ["k"], "t", ["d"], 20).collect():
        pts = sorted(frames[r["k"]])
        t = min(max(r["t"], pts[0][0]), pts[-1][0])
        want = next((d for x, d in pts if x == t), None)
        if want is None:
            (x0, d0), (x1, d1) = max(p for p in pts if p[0] < t), min(p for p in pts if p[0] > t)
            want = d0 + (d1 - d0) * (t - x0) / (x1 - x0)
        assert abs(want - r["d"]) < 1e-6


def test_sessions(rows):
    both(lambda m: sessions(rows.select("k", "t", "id", "on"), ["k"], ["t", "id"], "t", F.col("on"), m))


def test_rows_without_a_key_do_not_meet_in_one_task(spark):
    from parcelspan.operators.keyed import left_join_known

    df = spark.range(0, 8000, 1, 8).select(F.col("id").alias("i"), F.when(F.col("id") % 4 == 0, F.col("id") % 50).alias("k"))
    other = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = left_join_known(df, other, "k")
        assert {(r.i, r.k, r.v) for r in joined.collect()} == {(r.i, r.k, r.v) for r in df.join(other, "k", "left").collect()}
        assert joined.count() == 8000
        assert joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_task_reads_a_bounded_part_of_a_shuffle(spark, folder):
    from parcelspan.plans.inputs import Inputs

    size, parts = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.unset(size)
    spark.conf.unset(parts)
    Inputs(spark, folder)
    assert int(spark.conf.get(size).rstrip("b")) == 16 << 20 and int(spark.conf.get(parts)) >= 1000
    spark.conf.set(size, "8m")
    spark.conf.set(parts, "30")
    Inputs(spark, folder)
    assert (spark.conf.get(size), spark.conf.get(parts)) == ("8m", "30")
    spark.conf.unset(size)
    spark.conf.unset(parts)
