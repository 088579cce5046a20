"""Queries of stored baselines and drift.

Line items ship in two periods; the second has planted shifts: a tenth of the quantities doubled, one
line status renamed and one return flag in thirty missing.
"""

from __future__ import annotations

from plumbline.operators import baseline
from plumbline.operators.table import Table
from plumbline.session import shared_folder

from .inputs import table
from .registry import query

PERIODS = {"1": "l_shipdate < DATE '1995-06-17'", "2": "l_shipdate >= DATE '1995-06-17'"}
PLAIN = "l_quantity, l_extendedprice, l_linestatus, l_returnflag, l_shipdate"
SHIFTED = ("CASE WHEN l_orderkey % 10 = 0 THEN l_quantity * 2 ELSE l_quantity END AS l_quantity, l_extendedprice, "
           "CASE WHEN l_linestatus = 'F' THEN 'X' ELSE l_linestatus END AS l_linestatus, "
           "CASE WHEN l_orderkey % 30 <> 0 THEN l_returnflag END AS l_returnflag, l_shipdate")
COLUMNS = {"l_quantity": "number", "l_extendedprice": "number", "l_linestatus": "text", "l_returnflag": "text",
           "l_shipdate": "date"}


def _cell(x: str) -> str:
    a, power = f"abs({x})", f"floor(log2(abs({x})))"
    exact = (f"(CASE WHEN pow(2, {power}) > {a} THEN {power} - 1 WHEN pow(2, {power} + 1) <= {a} THEN {power} + 1 "
             f"ELSE {power} END)")
    return (f"CAST(CASE WHEN {a} = 0 THEN 0 ELSE sign({x}) * (({exact} + 1100) * 8 "
            f"+ floor(({a} / pow(2, {exact}) - 1) * 8) + 1) END AS BIGINT)")


def state_sql(frame: str, columns: dict[str, str] = COLUMNS) -> str:
    """The state of ``frame`` from plain SQL."""
    parts = []
    for c, kind in columns.items():
        head = f"SELECT '{c}' AS column_name, '{kind}' AS kind"
        x = f"CAST({c} AS DOUBLE)"
        cell = {"number": _cell(x), "date": f"year({c}) * 12 + month({c})",
                "text": f"CAST(('0x' || substr(md5({c}), 12, 2)) AS BIGINT)"}[kind]
        parts.append(f"{head}, 'nulls' AS part, 0 AS bucket, count(*) AS n FROM {frame} WHERE {c} IS NULL HAVING count(*) > 0")
        parts.append(f"{head}, 'cells' AS part, CAST({cell} AS BIGINT) AS bucket, count(*) AS n FROM {frame} WHERE {c} IS NOT NULL GROUP BY ALL")
        name = f"md5(CAST({c} AS VARCHAR))"
        bits = f"CAST(('0x' || substr({name}, 4, 8)) AS BIGINT)"
        parts.append(f"{head}, 'registers' AS part, CAST(('0x' || substr({name}, 1, 3)) AS BIGINT) % 1024 AS bucket, "
                     f"max(CASE WHEN {bits} = 0 THEN 33 ELSE 33 - length(bin({bits})) END) AS n FROM {frame} WHERE {c} IS NOT NULL GROUP BY ALL")
        if kind == "text":
            parts.append(f"{head}, 'lengths' AS part, {_cell(f'CAST(length({c}) AS DOUBLE)')} AS bucket, count(*) AS n FROM {frame} WHERE {c} IS NOT NULL GROUP BY ALL")
    plain = " UNION ALL ".join(f"SELECT column_name, kind, part, CAST(bucket AS BIGINT) AS bucket, CAST(NULL AS VARCHAR) AS value, "
                               f"CAST(n AS BIGINT) AS n FROM ({p})" for p in parts)
    heavy = " UNION ALL ".join(
        f"SELECT '{c}', '{kind}', 'heavy', CAST(0 AS BIGINT), CAST({c} AS VARCHAR) AS v, count(*) FROM {frame} "
        f"WHERE {c} IS NOT NULL GROUP BY v HAVING 100 * count(*) >= (SELECT count(*) FROM {frame})" for c, kind in columns.items())
    return f"{plain} UNION ALL {heavy}"


def _frame(spark, sf_dir, period: str, shifted: bool = False) -> Table:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return Table(spark.sql(f"SELECT {SHIFTED if shifted else PLAIN} FROM lineitem WHERE {PERIODS[period]}"))


FIRST = f"(SELECT {PLAIN} FROM lineitem WHERE {PERIODS['1']})"
SECOND = f"(SELECT {SHIFTED} FROM lineitem WHERE {PERIODS['2']})"


@query("profile_baseline", state_sql(FIRST))
def profile_baseline(spark, sf_dir):
    """The state of the first period, written as a baseline and read back."""
    kept = baseline.Baselines(spark, shared_folder(spark))
    kept.save("lineitem", "1", baseline.profile_state(_frame(spark, sf_dir, "1")))
    return kept.load("lineitem")


@query("profile_baseline_merged", f"""
SELECT column_name, kind, part, bucket, CAST(CASE WHEN part = 'registers' THEN max(n) ELSE sum(n) END AS BIGINT) AS n
FROM ({state_sql(f"(SELECT {PLAIN} FROM lineitem)")}) WHERE part <> 'heavy' GROUP BY column_name, kind, part, bucket""")
def profile_baseline_merged(spark, sf_dir):
    """The merged states of both periods: the state of the whole table."""
    kept = baseline.Baselines(spark, shared_folder(spark))
    for period in PERIODS:
        kept.save("lineitem", period, baseline.profile_state(_frame(spark, sf_dir, period)))
    return kept.load("lineitem").where("part <> 'heavy'").drop("value")


@query("profile_drift", f"""
WITH s AS (SELECT 0 AS side, * FROM ({state_sql(FIRST)}) UNION ALL SELECT 1, * FROM ({state_sql(SECOND)})),
 c AS (SELECT column_name, kind, part, bucket, sum(CASE WHEN side = 0 THEN n ELSE 0 END) AS a, sum(CASE WHEN side = 1 THEN n ELSE 0 END) AS b
  FROM s WHERE part IN ('cells', 'lengths') GROUP BY ALL),
 t AS (SELECT *, sum(a) OVER g AS all_a, sum(b) OVER g AS all_b, count(*) OVER g AS k, sum(a) OVER u AS up_a, sum(b) OVER u AS up_b
  FROM c WINDOW g AS (PARTITION BY column_name, part), u AS (PARTITION BY column_name, part ORDER BY bucket)),
 p AS (SELECT *, (a + 0.5::DOUBLE) / (all_a + 0.5::DOUBLE * k) AS p, (b + 0.5::DOUBLE) / (all_b + 0.5::DOUBLE * k) AS q FROM t),
 d AS (SELECT column_name, part, round(sum((p - q) * ln(p / q)), 6) AS stability_index,
  round((max(k) - 1) * (1 / max(all_a)::DOUBLE + 1 / max(all_b)::DOUBLE), 6) AS chance,
  round(CASE WHEN kind = 'text' AND part = 'cells' THEN sum(abs(a / all_a - b / all_b)) / 2 ELSE max(abs(up_a / all_a - up_b / all_b)) END, 6) AS distance
  FROM p WHERE all_a > 0 AND all_b > 0 GROUP BY column_name, part, kind),
 z AS (SELECT column_name,
  coalesce(sum(n) FILTER (side = 0 AND part = 'nulls'), 0) / sum(n) FILTER (side = 0 AND part IN ('nulls', 'cells')) AS n0,
  coalesce(sum(n) FILTER (side = 1 AND part = 'nulls'), 0) / sum(n) FILTER (side = 1 AND part IN ('nulls', 'cells')) AS n1 FROM s GROUP BY column_name)
SELECT column_name, part, stability_index, chance, distance, round(n1 - n0, 6) AS null_change,
 CASE WHEN stability_index - chance >= 0.25 THEN 'MAJOR' WHEN stability_index - chance >= 0.1 THEN 'MODERATE' ELSE 'STABLE' END AS level
FROM d JOIN z USING (column_name)""")
def profile_drift(spark, sf_dir):
    kept = baseline.Baselines(spark, shared_folder(spark))
    kept.save("lineitem", "1", baseline.profile_state(_frame(spark, sf_dir, "1")))
    return baseline.drift(kept.load("lineitem"), baseline.profile_state(_frame(spark, sf_dir, "2", shifted=True)))


@query("profile_summary", f"""
WITH s AS ({state_sql(FIRST)}),
 r AS (SELECT column_name, 1024 + sum(pow(2::DOUBLE, -n) - 1) AS held, 1024 - count(*) AS empty FROM s WHERE part = 'registers' GROUP BY column_name),
 e AS (SELECT column_name, empty, 0.7213::DOUBLE / (1 + 1.079::DOUBLE / 1024) * 1024 * 1024 / held AS raw FROM r)
SELECT column_name, kind, CAST(coalesce(sum(n) FILTER (part IN ('cells', 'nulls')), 0) AS BIGINT) AS rows,
 CAST(coalesce(sum(n) FILTER (part = 'nulls'), 0) AS BIGINT) AS nulls,
 CAST(round(any_value(CASE WHEN raw <= 2560 AND empty > 0 THEN 1024 * ln(1024::DOUBLE / empty) ELSE raw END)) AS BIGINT) AS distinct_estimate
FROM s JOIN e USING (column_name) GROUP BY column_name, kind""")
def profile_summary(spark, sf_dir):
    state = baseline.profile_state(_frame(spark, sf_dir, "1"))
    return baseline.summary(state).drop("median", "low", "high")
