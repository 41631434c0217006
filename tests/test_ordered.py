from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stakelens.operators.ordered import Ordered
from stakelens.operators import asof_lookup, keep_first, lag, last_value, lead, ordered, running_max_before, running_sum


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = [
        ("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2, 3]), rng.randrange(9))
        for i in range(500)
    ]
    return spark.createDataFrame(data, "k string, at int, v int, n int")


def steps():
    return dict(
        before=lag("v"), after=lead("v"), latest=last_value(F.col("v")), total=running_sum(F.col("n")),
        top=running_max_before(F.col("n")),
    )


@pytest.mark.parametrize("width", [1, 7, 100_000])
def test_sliced_groups_give_what_windows_give(rows, width):
    plain = Ordered(rows, ["k"], ["at"], sliced=False).add(**steps()).add(twice=lag("before")).result()
    cut = ordered(rows, ["k"], ["at"], width).add(**steps()).add(twice=lag("before")).result()
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, cut.select(plain.columns).collect()), key=str)


def test_nothing_runs_while_a_plan_is_built(spark, rows):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    ordered(rows, ["k"], ["at"], 7).add(**steps()).result()
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_slices_need_times_or_numbers(rows):
    with pytest.raises(TypeError):
        ordered(rows, ["at"], ["k"])


def test_keep_first_limits_before_the_exchange(spark, rows):
    first = keep_first(rows, ["k"], ["n"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("Partial")
    assert plan.index("Final") < plan.index("Exchange") < partial, "read bottom up: partial limit, exchange, final"
    assert first.count() == 4


@pytest.mark.parametrize("width", [3600, 30 * 86_400])
def test_asof_is_half_open(spark, width):
    t0 = datetime(2024, 1, 1)
    periods = spark.createDataFrame(
        [("p", t0 + timedelta(days=i), t0 + timedelta(days=i + 1) if i < 9 else None, f"v{i}") for i in range(10)]
        + [("gap", t0, t0 + timedelta(days=1), "only")],
        "player_id string, valid_from timestamp, valid_to timestamp, tier string",
    )
    events = spark.createDataFrame(
        [(i, "p", t0 + timedelta(hours=6 * i - 12)) for i in range(44)]
        + [(90, "gap", t0 + timedelta(days=1)), (91, "gap", t0 + timedelta(hours=23)), (92, "nobody", t0)],
        "id int, player_id string, ts timestamp",
    )
    found = asof_lookup(events, periods, "player_id", "ts", ["tier"], width)
    got = {r.id: r.tier for r in found.collect()}
    want = {i: f"v{min((6 * i - 12) // 24, 9)}" for i in range(44) if 6 * i >= 12}
    assert got == {**want, 91: "only"}
