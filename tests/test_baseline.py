"""Profile states: merged in any order, bounded errors, drift where it was planted."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from plumbline.operators import baseline
from plumbline.operators.fixes import Context, apply_fix
from plumbline.operators.table import Table

from .helpers import AS_OF

SCHEMA = "k int, amount double, name string, day date"


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice([None, rng.gauss(0, 1000), 7.0, 0.0]), rng.choice([None, "x", "", f"name {rng.randrange(400)}"]),
             rng.choice([None, dt.date(2020, 1 + i % 12, 3)])) for i in range(n)]


def state_of(spark, values):
    return baseline.profile_state(Table(spark.createDataFrame(values, SCHEMA), "k"))


def cells(state):
    return sorted(map(tuple, state.select(*baseline.KEYS, "n").where("part <> 'heavy'").collect()), key=str)


def test_states_merge_in_any_order_and_number(spark):
    values = rows(900)
    whole = cells(state_of(spark, values))
    parts = [state_of(spark, values[i::3]) for i in range(3)]
    one = baseline.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    two = baseline.merged(parts[2].unionByName(baseline.merged(parts[1].unionByName(parts[0]))))
    assert cells(one) == cells(two) == whole


def test_cells_hold_their_numbers_in_order(spark):
    rng = random.Random(2)
    numbers = sorted([0.0, 1.0, -1.0, 2.0 ** 29, 2.0 ** -1070, 1e308, -1e308, math.inf, -math.inf, 0.1, 8.0, 7.999999999999999]
                     + [rng.gauss(0, 1) * 10 ** rng.randint(-8, 8) for _ in range(500)])
    found = spark.createDataFrame([(x,) for x in numbers], "x double").select(
        "x", baseline.number_cell(F.col("x")).alias("c")).withColumn("m", baseline.cell_middle(F.col("c"))).collect()
    found.sort(key=lambda r: r["x"])
    assert all(a["c"] <= b["c"] for a, b in zip(found, found[1:]))
    for r in found:
        if math.isfinite(r["x"]) and abs(r["x"]) > 1e-300:
            assert abs(r["m"] - r["x"]) <= abs(r["x"]) / 15.9


def test_summary_errors(spark):
    rng = random.Random(3)
    values = [(i, float(rng.randrange(1, 5000)), f"id {i % 3000}", None) for i in range(9000)]
    got = {r["column_name"]: r for r in baseline.summary(state_of(spark, values)).collect()}
    exact = len({v[1] for v in values})
    assert abs(got["amount"]["distinct_estimate"] - exact) < 4 * baseline.distinct_error() * exact
    assert abs(got["name"]["distinct_estimate"] - 3000) < 4 * baseline.distinct_error() * 3000
    median = sorted(v[1] for v in values)[4500]
    assert abs(got["amount"]["median"] - median) <= median / 8
    assert (got["day"]["rows"], got["day"]["nulls"]) == (9000, 9000)


def test_heavy_values_survive_merging(spark):
    values = [(i, None, "hot" if i % 60 == 0 else f"v{i}", None) for i in range(1200)]
    parts = [state_of(spark, values[i:i + 300]) for i in range(0, 1200, 300)]
    states = parts[0]
    for p in parts[1:]:
        states = states.unionByName(p)
    found = {r["value"]: r["n"] for r in baseline.merged(states).where("part = 'heavy'").collect()}
    assert found == {"hot": 20}


def test_drift_tells_shifted_columns(spark):
    before = rows(3000)
    after = [(k, None if a is None else a * (3 if k % 2 else 1), "renamed" if n == "x" else n, None if k % 2 else d)
             for k, a, n, d in rows(3000, seed=9)]
    found = {(r["column_name"], r["part"]): r for r in
             baseline.drift(state_of(spark, before), state_of(spark, after)).collect()}
    same = {(r["column_name"], r["part"]): r for r in
            baseline.drift(state_of(spark, before), state_of(spark, rows(3000, seed=9))).collect()}
    assert all(r["level"] == "STABLE" for r in same.values())
    assert found["amount", "cells"]["level"] != "STABLE" and found["name", "cells"]["level"] == "MAJOR"
    assert abs(found["day", "cells"]["null_change"] - 0.25) < 0.05


def test_baselines_are_kept_per_batch(spark, tmp_path):
    values = rows(400)
    kept = baseline.Baselines(spark, str(tmp_path))
    assert kept.load("sales").count() == 0
    for i in range(2):
        table = spark.createDataFrame(values[i::2], SCHEMA)
        for _ in range(2):      # a batch that is saved again is replaced
            fixed = apply_fix(table, "profiling", Context(AS_OF, "k", {"baseline": (str(tmp_path), "sales", f"b{i}")}))
    assert fixed.log.first()["action"] == "lock_profiling_baseline" and fixed.df.count() == 200
    assert cells(kept.load("sales")) == cells(state_of(spark, values))
    assert cells(kept.load("sales", ["b1"])) == cells(state_of(spark, values[1::2]))


def test_empty_and_odd_tables(spark):
    assert state_of(spark, []).count() == 0
    assert baseline.summary(state_of(spark, [])).count() == 0
    odd = spark.createDataFrame([(1, float("nan"), [1]), (2, None, None)], "k int, x double, xs array<int>")
    state = baseline.profile_state(Table(odd, "k")).collect()
    assert [(r["column_name"], r["part"], r["n"]) for r in state] == [("x", "nulls", 2)]
    assert baseline.drift(state_of(spark, rows(50)), state_of(spark, [])).count() == 0


def test_a_state_is_counted_once(spark, tmp_path):
    """What reads a state, drift among them, reads its few rows and not the table."""
    spark.createDataFrame(rows(400), SCHEMA).write.parquet(f"{tmp_path}/t")
    state = baseline.profile_state(Table(spark.read.parquet(f"{tmp_path}/t"), "k"))
    assert state.inputFiles() and not any(str(tmp_path / "t") in f for f in state.inputFiles())


def test_states_of_all_kinds_of_values(spark):
    """Cells and heavy values of nulls, zeros, empty texts and dates, counted here by hand."""
    values = [(1, 0.0, "", dt.date(2020, 2, 29)), (2, -3.0, None, None), (3, None, "é€", dt.date(2020, 2, 1)), (4, 0.0, "", None)]
    got = {(r["column_name"], r["part"], r["bucket"], r["value"]): r["n"] for r in state_of(spark, values).collect()
           if r["part"] in ("nulls", "lengths", "heavy") or r["part"] == "cells" and r["column_name"] != "name"}
    two = (1 + 1100) * 8 + 1
    assert got == {
        ("amount", "nulls", 0, None): 1, ("amount", "cells", 0, None): 2, ("amount", "cells", -(two + 4), None): 1,
        ("amount", "heavy", 0, "0.0"): 2, ("amount", "heavy", 0, "-3.0"): 1,
        ("name", "nulls", 0, None): 1, ("name", "lengths", 0, None): 2, ("name", "lengths", two, None): 1,
        ("name", "heavy", 0, ""): 2, ("name", "heavy", 0, "é€"): 1,
        ("day", "nulls", 0, None): 2, ("day", "cells", 2020 * 12 + 2, None): 2,
        ("day", "heavy", 0, "2020-02-29"): 1, ("day", "heavy", 0, "2020-02-01"): 1}
