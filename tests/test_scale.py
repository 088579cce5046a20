"""Operators built for size: exact quantiles, row numbers, hot keys, neighbours."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import duplicates, entities, privacy, similar
from plumbline.operators.fixes import keep_last
from plumbline.operators.ordering import attach, with_row_number
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.similar import SimilarValues
from plumbline.operators.table import Table

from workload import inputs

from .helpers import indel


@pytest.mark.parametrize("values", [
    [random.Random(1).gauss(0, 1000) for _ in range(5000)],
    [7.0] * 2000 + [float(i) for i in range(3000)],
    [7.0] * 4000,
    [1e9] * 5 + [float(i % 3) for i in range(4000)],
    [float(i) for i in range(2001)],
])
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(8)
    probabilities = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, {"x": F.col("x")}, probabilities, fetch=20, accuracy=100)["x"]
    assert got["count"] == len(values)
    assert got["quantiles"] == pytest.approx(list(np.quantile(values, probabilities)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, {"x": F.col("x")}, [0.5])["x"]["quantiles"] is None


def test_row_numbers_are_dense_and_ordered(spark):
    keys = list(range(1000))
    random.Random(3).shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(13)
    got = with_row_number(df, ["k"], "n").collect()
    assert len(got) == 1000 and all(r["k"] == r["n"] for r in got)


def test_attach_with_a_hot_key(spark):
    """A third of the rows share one key, some have none."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"v{i % 1500}") for i in range(6000)]
    df = spark.createDataFrame(rows, "k int, v string")
    found = (df.where("v IS NOT NULL AND v <> 'v1'").groupBy("v").agg(F.count("*").alias("rows"))
             .withColumn("t", F.concat(F.lit("T"), "v")))
    got = {r["k"]: r["t"] for r in attach(df, "v", found, ["t"], "rows").collect()}
    assert got == {k: None if v in (None, "v1") else f"T{v}" for k, v in rows}


def brute_neighbours(rows, threshold, window):
    rows = sorted(r for r in rows if r[1] is not None)
    out = set()
    for i, (k, v) in enumerate(rows):
        for k2, v2 in rows[i + 1:i + 1 + window]:
            if v + v2 and threshold <= indel(v, v2) < 100:
                out.add((k, k2))
    return out


@pytest.mark.parametrize("block", [20, 37, 20_000])
def test_neighbours_match_brute_force(spark, block):
    random.seed(5)
    names = ["Anna Maria Schmidt", "Anna Marie Schmidt", "Ana Maria Schmid", "Bob", "Bobb", "Carl Gustav Larsson",
             "Carl Gustaf Larsson", "", "x"]
    rows = [(i, random.choice(names + [None])) for i in range(400)]
    t = Table(spark.createDataFrame(rows, "k int, customer_name string").repartition(5), "k")
    got = {(r["left_key"], r["right_key"]) for r in
           duplicates.similar_neighbours(t, "customer_name", 85, 19, block).collect()}
    assert got == brute_neighbours(rows, 85, 19)


def test_neighbours_of_long_texts(spark):
    random.seed(6)
    base = "".join(random.choice("abcdefgh ") for _ in range(900))
    rows = [(i, base[:i * 7 % 850] + "zz" + base[i * 7 % 850 + 3 * (i % 60):]) for i in range(40)]
    t = Table(spark.createDataFrame(rows, "k int, name string"), "k")
    got = {(r["left_key"], r["right_key"]) for r in duplicates.similar_neighbours(t, "name").collect()}
    assert got == brute_neighbours(rows, 90, 19) and got


def near_classes(rows, threshold):
    """{(smallest key, smallest key)} of near values, and {key: (class key, class rows, links, near rows)}"""
    held = {}
    for k, v in rows:
        if v:
            held.setdefault(v, []).append(k)
    firsts = sorted((min(ks), v) for v, ks in held.items())
    pairs = {(k, k2) for (k, v), (k2, v2) in itertools.combinations(firsts, 2)
             if 200 * min(len(v), len(v2)) >= threshold * (len(v) + len(v2)) and threshold <= indel(v, v2) < 100}
    count = {k: len(held[v]) for k, v in firsts}
    near = {k: [count[b if a == k else a] for a, b in pairs if k in (a, b)] for k, _ in firsts}
    return pairs, {k: (f, count[f], len(near[f]), sum(near[f])) for f, v in firsts for k in held[v]}


def check_similar(spark, rows, threshold=90.0, column="customer_name"):
    t = Table(spark.createDataFrame(rows, f"k int, {column} string").repartition(5), "k")
    pairs, members = near_classes(rows, threshold)
    found = SimilarValues(t, column, threshold)
    got = [(r["left_key"], r["right_key"]) for r in found.links().collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    assert {r["k"]: (r["class_key"], r["class_rows"], r["links"], r["near_rows"])
            for r in found.members().collect()} == members
    linked = found.values.join(found.linked(), "h", "left_semi")
    assert {r["k"] for r in linked.collect()} == {k for pair in pairs for k in pair}
    issue = duplicates.similar_pairs_issue(t, column, len(rows), threshold).first()
    wanted = sum(m[2] > 0 for m in members.values())
    assert wanted == (issue["affected_rows"] if issue else 0)
    return pairs


@pytest.mark.parametrize("threshold", [90.0, 80.0, 60.0])
def test_similar_values_over_the_whole_table(spark, threshold):
    """Short values exactly as brute force, at any distance; equal values are one class."""
    rng = random.Random(11)
    names = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 20))) for _ in range(60)]
    names += [n[:i] + "z" + n[i + rng.randint(0, 1):] for n in names for i in [rng.randrange(len(n))]]
    names += names[:10] * 3 + ["", None, f"Customer#{7:09}", f"Customer#{8:09}", f"Customer#{77:09}"]
    rng.shuffle(names)
    assert check_similar(spark, list(enumerate(names)), threshold)


@pytest.mark.parametrize("threshold", [90.0, 75.0])
def test_similar_values_of_all_lengths(spark, threshold):
    """Around the limits of the methods and far beyond, with changes close together and spread evenly."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in [2, 3, 4, 6, 9, 15, 30, 36, 45, 120] * 3]
    texts += ["".join(rng.choice("abcdé") for _ in range(n)) for n in [*range(14, 28, 2), *range(170, 240, 10)]]
    copies = [" ".join(rng.choice(words) if rng.random() < 0.04 else w for w in t.split()) for t in texts]
    for t in texts:
        every = rng.randint(8, 30)      # a change every few characters
        copies.append("".join("#" if i % every == every - 1 else c for i, c in enumerate(t)))
        cut = rng.randint(0, max(1, len(t) // 6))
        copies.append(t[cut:])
    assert len(check_similar(spark, list(enumerate(texts + copies)), threshold, "name")) > 30


def test_hot_values_and_keys(spark):
    """A value that a third of the rows hold is one class; a key that all values share gives counts."""
    rows = [(i, "Smith & Sons Ltd" if i % 3 == 0 else f"Smith & Sons {i % 40:02}") for i in range(600)]
    check_similar(spark, rows)
    t = Table(spark.createDataFrame(rows, "k int, customer_name string"), "k")
    assert SimilarValues(t, "customer_name").members().count() == 600
    empty = Table(spark.createDataFrame([], "k int, customer_name string"), "k")
    assert SimilarValues(empty, "customer_name").links().count() == 0


def test_short_pairs_come_out_of_the_join_once(spark):
    """Names of one length: no ratio in Python, no pair shuffled, though a pair shares several keys."""
    names = [f"Customer#{i:09}" for i in [*range(40), 111, 1110, 11100, 111000]] + ["aaaaaaaaaaaaaaaaab", "aaaaaaaaaaaaaaaaba"]
    t = Table(spark.createDataFrame(list(enumerate(names)), "k int, customer_name string"), "k")
    found = SimilarValues(t, "customer_name").short_ratios()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Aggregate" not in plan
    got = [(r["x"]["k"], r["y"]["k"], r["ratio"]) for r in found.collect()]
    wanted = {(i, j): indel(names[i], names[j]) for i, j in itertools.combinations(range(len(names)), 2)}
    assert len(got) == len(wanted := {p: r for p, r in wanted.items() if r >= 90})
    assert {(min(a, b), max(a, b)): r for a, b, r in got} == wanted


@pytest.mark.parametrize("name", ["run_scores", "issue_log", "fix_events"])
def test_views_of_many_groups_are_dealt_before_they_are_grouped(spark, tmp_path, name):
    """One shuffle, of rows by their run, in pieces of a file split; also with null keys."""
    rows = [(i % 50 if i % 7 else None, i % 9, i % 5, i % 4, float(i % 30), f"2000-01-{1 + i % 28:02}") for i in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                "l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    dealt = inputs.view(spark, str(tmp_path), name)
    plain = inputs.table(spark, str(tmp_path), "lineitem")
    assert dealt.rdd.getNumPartitions() >= inputs.PIECES * plain.rdd.getNumPartitions()
    plain.createOrReplaceTempView("lineitem")
    assert sorted(dealt.collect(), key=str) == sorted(spark.sql(inputs.VIEWS[name]).collect(), key=str)


def test_repeated_rows_exactly(spark):
    rows = [(1, "a", None), (1, "a", None), (1, "a", None), (2, "b", 1.0), (2, "b", -0.0), (2, "b", 0.0)]
    got = duplicates.repeated_rows(spark.createDataFrame(rows, "i int, s string, x double")).first()
    assert (got["total_rows"], got["duplicate_rows"], got["uniqueness_rate"]) == (6, 3, 50.0)
    none = duplicates.repeated_rows(spark.createDataFrame([(1,), (2,)], "i int")).first()
    assert none["duplicate_rows"] == 0


def test_nulls_and_empty_tables_in_repeated_rows(spark):
    rows = [(None, "a"), ("a", None), ("a", None), ("", None), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = duplicates.repeated_rows(df).first()
    assert (got["total_rows"], got["duplicate_rows"], got["unique_rows"]) == (6, 2, 4)
    none = duplicates.repeated_rows(df.where("false")).first()
    assert (none["total_rows"], none["duplicate_rows"], none["uniqueness_rate"]) == (0, 0, 100.0)


def test_hot_ids(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 5 == 0 else str(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, order_id string")
    kept = keep_last(df, "order_id", "k").collect()
    assert sorted(r["k"] for r in kept if r["order_id"] == "hot") == [897]
    assert sum(r["order_id"] is None for r in kept) == sum(v is None for _, v in rows)
    assert sum(r["order_id"] is None for r in keep_last(df, "order_id", "k", parity=True).collect()) == 1
    t = Table(df, "k")
    again = duplicates.repeated_id_rows(t, "order_id").collect()
    assert sorted(r["k"] for r in again) == [k for k, v in rows if v == "hot"]


def test_rank_filter_runs_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "k int, order_id string")
    plan = keep_last(df, "order_id", "k", parity=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_golden_record_takes_first_known_value(spark):
    rows = [(3, "A", None, "z"), (1, "A", None, "x"), (2, "A", 5, None), (4, None, 9, "n"), (5, None, 8, "m")]
    df = spark.createDataFrame(rows, "k int, customer_id string, age int, name string")
    got = sorted((tuple(r) for r in entities.golden_records(df, "customer_id", "k").collect()), key=str)
    assert got == sorted([(1, "A", 5, "x"), (4, None, 9, "n"), (5, None, 8, "m")], key=str)
    assert entities.golden_records(df, "customer_id", "k", keep_null_keys=False).count() == 1


def test_conflicts_name_the_first_field(spark):
    rows = [(1, "A", "n", "p1"), (2, "A", "n", "p2"), (3, "B", "n", "p"), (4, "B", None, "p"), (5, "C", "n", "p")]
    t = Table(spark.createDataFrame(rows, "k int, customer_id string, name string, phone string"), "k")
    assert [(r["entity"], r["conflict_field"]) for r in entities.conflicts(t, "customer_id").collect()] == [("A", "phone")]
    facts = entities.survivorship_facts(t, "customer_id").first()
    assert (facts["repeated_entities"], facts["repeated_rows"], facts["conflicting_entities"]) == (2, 4, 1)


def test_tokens_follow_first_appearance(spark):
    rows = [(10, "b"), (11, "a"), (12, "b"), (13, None), (14, "c")]
    df = spark.createDataFrame(rows, "k int, email string").repartition(4)
    out, log, maps = privacy.protect(df, {"email": "tokenize"}, "k")
    got = {r["k"]: r["email"] for r in out.collect()}
    assert got == {10: "TOKEN-EMAI-000001", 11: "TOKEN-EMAI-000002", 12: "TOKEN-EMAI-000001", 13: None,
                   14: "TOKEN-EMAI-000003"}
    back = {r["token"]: r["value"] for r in maps["email"].collect()}
    assert back["TOKEN-EMAI-000003"] == "c" and log.first()["rows_affected"] == 4


def test_top_values_with_long_ties(spark):
    """Ties beyond the characters that travel with the counts go to the smallest value."""
    rng = random.Random(4)
    head = "the same first characters "
    values = [head + str(rng.randrange(30)) for _ in range(300)] + ["b"] * 9 + ["a"] * 9 + [None] * 20
    t = Table(spark.createDataFrame(list(enumerate(values)), "k int, v string").repartition(6), "k")
    counts = {}
    for v in values:
        if v is not None:
            counts[v] = counts.get(v, 0) + 1
    wanted = sorted(counts, key=lambda v: (-counts[v], v))
    for size in (1, 5, 40):
        got = duplicates.top_counts(t, ["v"], size).orderBy("place").collect()
        assert [(r["value"], r["rows"]) for r in got] == [(v, counts[v]) for v in wanted[:size]]


def test_texts_stay_out_of_the_shuffle(spark):
    """Counting values and dropping copies shuffles hashes, keys and counts."""
    df = spark.createDataFrame([(1, "x" * 90, "y")], "k int, body string, note string")
    t = Table(df, "k")
    plans = [duplicates.value_counts(t, ["body"]), duplicates.repeated_rows(df, ["body", "note"])]
    for frame in plans:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        for line in plan.split("\n"):
            if "Exchange" in line:
                assert "body" not in line and "value" not in line, line
    kept = duplicates.without_copies(Table(spark.createDataFrame(
        [(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "k int, v string"), "k"))
    assert sorted(r["k"] for r in kept.collect()) == [1, 2, 4]
    copied = duplicates.copy_rows(Table(spark.createDataFrame(
        [(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "k int, v string"), "k"))
    assert sorted(r["k"] for r in copied.collect()) == [3, 5]


def test_long_values_meet_block_by_block(spark, monkeypatch):
    """Long values that share their grams: no pair is lost between blocks or bands, none is compared twice, and
    no gram of them is indexed."""
    rng = random.Random(5)
    words = ["ation", "ment", "er", "ing", "un", "ly"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(60, 160))) for _ in range(90)]
    copies = ["".join(c if rng.random() > 0.06 else rng.choice("xyz") for c in t) for t in texts[:25]]
    copies += [t[len(t) // 12:] for t in texts[:10]] + [t[:90] + "é" * 20 + t[90:] for t in texts[5:15]]
    monkeypatch.setattr(similar, "BLOCK", 16)
    indexed = []
    prefixes = similar._prefixes
    monkeypatch.setattr(similar, "_prefixes", lambda values, *a: (indexed.append(values), prefixes(values, *a))[1])
    pairs = check_similar(spark, list(enumerate(texts + copies + texts[:4])), 90.0, "name")
    assert len(pairs) > 40
    assert all(r["size"] < 250 for values in indexed for r in values.select("size").collect())


def test_common_subsequence_within_reach():
    """The comparison gives the length of the common subsequence wherever it reaches the need, else nothing;
    comparing the starts never gives up such a pair."""
    rng = random.Random(6)
    for _ in range(300):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(2, 300)))
        b = "".join(c for c in a if rng.random() > 0.1) + "é" * rng.randint(0, len(a) // 4) + "a"
        cut = rng.randint(0, len(a) // 5)
        b = b[cut:] or "a"
        common = round(indel(a, b) * (len(a) + len(b)) / 200)
        for need in {max(1, common - 7), common, common + 1} - {0}:
            assert similar.Compared(a).common(b, need) == (common if common >= need else -1)
        if common:
            alphabet = {ch: i for i, ch in enumerate(sorted(set(b)), 1)}
            codes = [np.array([alphabet[ch] for ch in b], np.uint8)]
            for share in (0.2, 0.5, 1.0):
                assert similar._starts_agree(a, codes, alphabet, np.array([common]), share)[0]
            assert not similar._starts_agree(a, codes, alphabet, np.array([common + 1]), 1.0)[0] or common + 1 > len(b)


def test_lanes_share_their_masks(monkeypatch):
    """A character of a long value is one step for many others, several of them in one lane: values are compared one by one
    only where few are left, and no pair is lost, with hardly a character in common or many, or more characters than kinds."""
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(42, 50))) for _ in range(36)]
    far = ["".join(chr(0x4e00 + rng.randrange(600)) for _ in range(rng.randint(210, 230))) for _ in range(10)]
    copies = ["".join(c if rng.random() > share else rng.choice("xyz") for c in t)
              for t in texts[:6] + far[:3] for share in (0.03, 0.08)]
    copies += [t[:cut] + "é" * 12 + t[cut + move:] for t, cut, move in zip(texts[:8], range(0, 240, 30), (0, 3, 20, 12) * 2)]
    hot = ["".join(c if rng.random() > 0.02 else rng.choice("xyz") for c in texts[20]) for _ in range(14)]
    rows = sorted(texts + far + copies + hot, key=len)
    steps, alone = [], []
    step, one = similar.Lanes.common, similar.Compared.common
    monkeypatch.setattr(similar.Lanes, "common", lambda self, code, *a: (steps.append(self.group), step(self, code, *a))[1])
    monkeypatch.setattr(similar.Compared, "common", lambda self, *a: (alone.append(1), one(self, *a))[1])
    got = {tuple(sorted((i, j))): ratio for i, j, ratio in similar._near_in_block(rows, rows, True, 90.0)}
    wanted = {(i, j): r for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2)
              if 200 * min(len(a), len(b)) >= 90 * (len(a) + len(b)) and 90 <= (r := indel(a, b)) < 100}
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-9 for k in got)
    assert similar.GROUP in steps and 1 in steps and len(alone) < len(rows) ** 2 // 10
    # Two blocks of mixed lengths find the pairs between them, whatever side the shorter value is on.
    left, right = rows[::2], rows[1::2]
    between = {(2 * i, 2 * j + 1) for i, j, _ in similar._near_in_block(left, right, False, 90.0)}
    assert {tuple(sorted(k)) for k in between} == {k for k in wanted if (k[0] + k[1]) % 2}
    # Blocks follow the lengths, and those that a value may be near to are among the ones it is sent to.
    sizes = [(s, n, s, s) for s, n in ((200, 5000), (210, 10), (230, 4000), (250, 1), (300, 3), (5_000_000, 2))]
    blocks = similar._blocks(sizes, 110 / 90)
    for size, at, parts, first, last in blocks:
        for size2, at2, parts2, _, _ in blocks:
            if 200 * min(size, size2) >= 90 * (size + size2):
                assert first <= at2 and at2 + parts2 - 1 <= last
    assert [parts for _, _, parts, _, _ in blocks[:2]] == [3, 1]
