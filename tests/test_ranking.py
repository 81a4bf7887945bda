import random

import pytest
from pyspark.sql import functions as F

from tests.fixtures import rows
from wiretally.operators.ranking import FAN_IN, GROUP_LIMIT, dense_index, lanes_by_round, top_k


@pytest.mark.parametrize("k", [1, 10, 256, 1500, 10_000])
def test_top_k_over_many_partitions(spark, k):
    rng = random.Random(k)
    data = [(g, f"h{i:05d}", rng.randrange(50)) for g in ("a", "b") for i in range(4000)]
    df = spark.createDataFrame(data, "capture string, ip string, n long").repartition(150)
    expected = []
    for g in ("a", "b"):
        best = sorted((r for r in data if r[0] == g), key=lambda r: (-r[2], r[1]))[:k]
        expected += [(*r, i) for i, r in enumerate(best, 1)]
    assert rows(top_k(df, k)) == sorted(expected)


def test_top_k_forwards_k_rows_per_partition(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 'a', 'b') capture", "id ip", "id % 7 n")
    before = spark.conf.get(GROUP_LIMIT)
    plan = top_k(df.repartition(8), 2000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4  # partial and final, twice
    top_k(df, 10_000)
    assert spark.conf.get(GROUP_LIMIT) == before
    with pytest.raises(ValueError):
        top_k(df, 0)


def test_dense_index_across_blocks_and_signs(spark):
    rng = random.Random(7)
    seconds = {c: sorted(rng.sample(range(-300_000, 2_000_000), 900)) for c in ("a", "b")}
    data = [(c, s, s * 2) for c, list_ in seconds.items() for s in list_]
    df = spark.createDataFrame(data, "capture string, second long, value long").repartition(9)
    indexed = dense_index(df, "second", F.shiftright("second", 16))
    expected = [(c, s, s * 2, i) for c, l in seconds.items() for i, s in enumerate(l)]
    assert rows(indexed, "capture", "second", "value", "idx") == sorted(expected)


def test_dense_index_of_a_whole_table(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(300)], "ip string")
    block = F.substring("ip", 1, 3)
    assert rows(dense_index(df, "ip", block, by=())) == [(f"k{i:03d}", i) for i in range(300)]


def test_no_task_sorts_more_than_its_share_at_the_default_threshold(spark):
    # All rows in two partitions and one group, k beyond what Spark limits by itself.
    df = spark.range(0, 40_000, 1, 2).selectExpr("'a' capture", "id ip", "hash(id) % 1000 n")
    before, shuffles = spark.conf.get(GROUP_LIMIT), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(GROUP_LIMIT, "1000")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        top = top_k(df, 1500)
        plan = top._jdf.queryExecution().optimizedPlan().toString()
        got = rows(top, "ip", "n", "rank")
        lane = F.pmod(F.xxhash64("capture", "n", "ip"), F.lit(40))
        largest = df.groupBy(lane).count().agg(F.max("count")).head()[0]
    finally:
        spark.conf.set(GROUP_LIMIT, before)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    # Forty lanes, three, one.
    assert plan.count("row_number()") == 3 and plan.count("xxhash64") == 1
    assert largest < 2 * 40_000 / 40
    data = sorted(((r["ip"], r["n"]) for r in df.collect()), key=lambda r: (-r[1], r[0]))[:1500]
    assert got == sorted((ip, n, i) for i, (ip, n) in enumerate(data, 1))


def test_rounds_of_a_ranking():
    assert [lanes_by_round(n) for n in (1, 8, 200, 100_000)] == [[], [8], [200, 13], [100_000, 6250, 391, 25, 2]]
    assert all(a <= FAN_IN * b for r in map(lanes_by_round, range(1, 5000, 7)) for a, b in zip(r, [*r[1:], 1]))


def test_columns_of_any_name_are_kept(spark):
    df = spark.createDataFrame([("a", "x", 3, 7), ("a", "y", 5, 8)], "capture string, ip string, n long, _lane long")
    assert rows(top_k(df, 1), "ip", "n", "_lane", "rank") == [("y", 5, 8, 1)]
