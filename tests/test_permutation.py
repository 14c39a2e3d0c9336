"""The keyed permutation and the passes made of it."""

import pytest
from pyspark.sql import functions as F

from titletags.operators import batches
from titletags.operators.permutation import permuted, round_keys


def places(spark, n, seed):
    size = F.lit(n).cast("long")
    rows = spark.range(n).select("id", permuted(F.col("id"), size, round_keys(F.lit(seed), size)).alias("at"))
    return [r["at"] for r in rows.orderBy("id").collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_every_number_has_a_place_of_its_own(spark, n):
    assert sorted(places(spark, n, 5)) == list(range(n))


def test_seeds_give_other_orders_without_a_pattern(spark):
    n = 2000
    first, second = places(spark, n, 1), places(spark, n, 2)
    assert sum(a == b for a, b in zip(first, second)) < 12
    assert sum(i == a for i, a in enumerate(first)) < 12
    steps = [b - a for a, b in zip(first, first[1:])]
    assert len(set(steps)) > 0.5 * n
    middle = [a < n / 2 for a in first[: n // 2]]
    assert 0.42 < sum(middle) / len(middle) < 0.58


def test_passes_hold_each_row_once_and_need_no_sort(spark, tmp_path):
    spark.range(101).select(F.col("id").alias("row_idx"), F.col("id").alias("x")).write.parquet(
        str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    cycled = batches.cycle_permuted(rows, 30, seed=9, size=8)
    plan = cycled._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "Repartition" not in plan
    found = cycled.collect()
    per_pass = 13
    assert {r["step"] for r in found} == set(range(30))
    for number in range(2):
        own = [r for r in found if r["pass_no"] == number]
        assert sorted(r["x"] for r in own) == list(range(101))
        assert all(r["step"] // per_pass == number and 0 <= r["slot"] < 8 for r in own)
        assert len({(r["step"], r["slot"]) for r in own}) == 101
    last = [r for r in found if r["pass_no"] == 2]
    assert len(last) == 4 * 8 and len({r["x"] for r in last}) == 32
    orders = [[r["x"] for r in sorted(found, key=lambda r: (r["step"], r["slot"])) if r["pass_no"] == i]
              for i in range(2)]
    assert orders[0] != orders[1]
    assert batches.cycle_permuted(rows.filter("false"), 5, seed=1).count() == 0
    assert batches.cycle_permuted(rows, 0, seed=1).count() == 0
