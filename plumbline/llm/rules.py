"""Quality rules: fixed limits, and outliers from robust estimates per language and source.

Only DataFrame functions are used. Counts are taken inside each row, so texts are never shuffled.
The outlier rule follows the minimum covariance determinant: from a robust start, concentration
steps take the ``CORE`` share of a group that lies nearest to the present estimate and estimate
mean and covariance from it again, which lowers the determinant each time. A text is rejected if
its squared Mahalanobis distance to its group's final estimate is beyond ``CUT``. Small groups take the
estimate of their language, or of the whole table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STATS = ("x1", "x2", "x3", "x4", "x5")
CORE, STEPS, LEAST = 0.75, 4, 30
#: Median and 0.999 quantile of the chi-square distribution with five degrees of freedom; the
#: quantile is the rejection limit.
CHI_MEDIAN, CUT = 4.351460, 20.515006
#: Where the core of a group has none at all, a share of more than so many percent is rejected.
SHARE = 20.0
#: Least standard deviations of the transformed statistics. Most texts have no symbols or repeated
#: lines at all, so without a floor a single one would be infinitely far.
FLOORS = (0.30, 0.10, *[math.log1p(SHARE) / math.sqrt(CUT)] * 3)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur at least twice in the array.

    Windows are compared by a 64-bit hash of their words.
    """
    def covered(starts):
        steps = F.transform(starts, lambda s, k: F.coalesce(
            F.least(F.lit(3), F.get(starts, k + 1) - s), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def again(hashes):
        def of(rows):
            same = F.filter(rows, lambda x, k: (
                F.coalesce(F.get(rows, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(rows, k + 1)["h"] == x["h"], F.lit(False))))
            return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(rows, of))

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                          lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(let(windows, again))


def counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
           groups: tuple = ("lang", "source")) -> DataFrame:
    """Word and line counts of every text, with its group columns."""
    value = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(value, F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(value, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    facts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"),
                                          repeated_words(w).cast("long").alias("r")))
    line_facts = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    return docs.select(
        F.col(id_column).alias("id"), *[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)],
        facts.alias("w"), line_facts.alias("l"),
        F.length(F.translate(value, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(value) - F.length(F.translate(value, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select("id", *[f"g{i}" for i in range(len(groups))], F.col("w.n").alias("n_words"), "word_chars",
             "n_symbols", F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"),
             F.col("l.n").alias("n_lines"))


def transformed() -> list[Column]:
    """The statistic vector: logarithms of counts, mean word length and shares in percent."""
    def share(part, whole):
        return F.log1p(F.lit(100.0) * F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log1p("n_words").alias("x1"), F.log1p(F.col("word_chars") / n).alias("x2"),
            share("n_symbols", "n_words").alias("x3"), share("n_dup_lines", "n_lines").alias("x4"),
            share("n_repeat_words", "n_words").alias("x5")]


def distance(stats=STATS) -> Column:
    """Squared Mahalanobis distance from the mean m_i and Cholesky factor l_ij in the row."""
    z = []
    for i, x in enumerate(stats):
        rest = F.col(x) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * z[j]
        z.append(rest / F.col(f"l_{i}_{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in z])


def factor(estimate: DataFrame, keys: list[str], p: int, floors=FLOORS) -> DataFrame:
    """Cholesky factors l_ij of the covariances c_ij, floors added to the diagonal."""
    out = estimate
    for i in range(p):
        for j in range(i + 1):
            value = F.col(f"c_{i}_{j}") + (floors[i] ** 2 if i == j else 0.0)
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            # With the floor the pivot is positive; the bound guards against rounding.
            value = (F.sqrt(F.greatest(value, F.lit(1e-9))) if i == j else value / F.col(f"l_{j}_{j}"))
            out = out.withColumn(f"l_{i}_{j}", value)
    return out.select(*keys, "n", *[f"m_{i}" for i in range(p)],
                      *[f"l_{i}_{j}" for i in range(p) for j in range(i + 1)])


def moments(rows: DataFrame, keys: list[str], stats=STATS) -> DataFrame:
    """n, means and covariances per group: one aggregate of partial sums."""
    p = range(len(stats))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m_{i}") for i, x in enumerate(stats)],
        *[F.covar_pop(stats[i], stats[j]).alias(f"c_{i}_{j}") for i in p for j in range(i + 1)])


def near(q: float) -> Column:
    """The q-quantile of the distance, over hundredths of its logarithm: few distinct values."""
    return F.percentile(F.round(F.log1p("d"), 2), q)


def estimates(points: DataFrame, keys: list[str], steps: int = STEPS, core: float = CORE,
              stats=STATS, floors=FLOORS) -> DataFrame:
    """Per group: n, m_i, l_ij and scale, after ``steps`` concentration steps.

    The start is the median and the median absolute deviation of each statistic. ``scale`` brings
    the median squared distance to that of the chi-square distribution.
    """
    p = len(stats)
    middle = points.groupBy(*keys).agg(*[
        F.percentile(F.round(x, 2), 0.5).alias(f"m_{i}") for i, x in enumerate(stats)])
    spread = points.join(middle, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(p)],
        *[F.pow(1.4826 * F.percentile(F.round(F.abs(F.col(x) - F.col(f"m_{i}")), 2), 0.5), F.lit(2.0))
          .alias(f"c_{i}_{i}") for i, x in enumerate(stats)])
    for i in range(p):
        for j in range(i):
            spread = spread.withColumn(f"c_{i}_{j}", F.lit(0.0))
    found = stored(factor(spread, keys, p, floors))
    for _ in range(steps):
        placed = points.join(found.drop("n"), keys).withColumn("d", distance(stats))
        limit = placed.groupBy(*keys).agg(near(core).alias("limit"))
        inner = placed.join(limit, keys).where(F.round(F.log1p("d"), 2) <= F.col("limit"))
        found = stored(factor(moments(inner, keys, stats), keys, p, floors))
    placed = points.join(found.drop("n"), keys).withColumn("d", distance(stats))
    scale = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), near(0.5).alias("half"))
    return found.drop("n").join(scale, keys).withColumn(
        "scale", F.greatest(F.expm1("half") / CHI_MEDIAN, F.lit(1.0))).drop("half")


def levels(points: DataFrame, keys: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """Which estimate judges each group, and which estimates each group's texts take part in.

    An estimate is named by ``level``, the number of leading keys it is made over, and by those keys
    (e0, e1, ...; empty beyond the level). A group is judged by the longest prefix of its keys that
    has ``least`` texts, at last by the whole table, however small. The first table has one row per
    group, the second one per group and estimate in use that the group belongs to.
    """
    p = len(keys)
    names = [f"e{i}" for i in range(p)]

    def prefix(level):
        return [(F.col(k) if i < level else F.lit("")).alias(e) for i, (k, e) in enumerate(zip(keys, names))]

    sizes = stored(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    level = F.when(F.col("n") >= least, p)
    found = sizes
    for j in range(p - 1, 0, -1):
        found = found.join(sizes.groupBy(*keys[:j]).agg(F.sum("n").alias(f"n{j}")), keys[:j])
        level = level.when(F.col(f"n{j}") >= least, j)
    named = [F.when(F.col("level") > i, F.col(k)).otherwise("").alias(e)
             for i, (k, e) in enumerate(zip(keys, names))]
    judges = stored(found.withColumn("level", level.otherwise(0)).select(*keys, "level", *named))
    used = judges.select("level", *names).distinct()
    member = [sizes.select(*keys, F.lit(j).alias("level"), *prefix(j)) for j in range(p + 1)]
    return judges, reduce(DataFrame.unionByName, member).join(used, ["level", *names], "left_semi")


def judge(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
          groups: tuple = ("lang", "source"), cut: float = CUT, least: int = LEAST) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept).

    ``base_failed``: fewer than 50 words, or more than half of them in repeated windows of three.
    The other texts are compared within their language and source (null is a group of its own).
    Groups of fewer than ``least`` texts are judged by the estimate of their language, languages of
    fewer by that of the whole table; these are made over all their texts, large groups included.
    ``distance`` is the scaled squared distance, null where the base rule failed. A null or empty
    text has no words and fails. Equal rows get equal answers; an empty table gives an empty one;
    other columns are ignored.
    """
    keys = [f"k{i}" for i in range(len(groups))]
    counted = stored(counts(docs, id_column, text, groups))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = counted.withColumns(
        {"base_failed": failed, **{f"k{i}": F.coalesce(F.concat(F.lit("v"), f"g{i}"), F.lit("n"))
                                   for i in range(len(groups))}})
    rows = rows.select("*", *transformed())
    points = rows.where(~F.col("base_failed")).select(*keys, *STATS)
    judges, members = levels(points, keys, least)
    names = ["level", *[f"e{i}" for i in range(len(groups))]]
    found = estimates(stored(points.join(members, keys).select(*names, *STATS)), names)
    judged = rows.join(judges.join(found, names).drop(*names), keys, "left")
    far = F.when(~F.col("base_failed"), distance() / F.col("scale"))
    return judged.withColumn("distance", far).select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))).alias("kept"))
