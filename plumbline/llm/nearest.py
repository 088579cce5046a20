"""Nearest neighbours by collision counting over single-projection sorted arrays.

Every vector is projected on ``LINES`` random lines; each line keeps its projections sorted, cut into
``SEGMENTS`` equal parts. A query opens a window around its own projection on every line, as wide as
its radius and rounded outwards to whole parts; a wider radius is a wider window on the same arrays
(virtual rehashing). A vector that lies in the windows of at least ``NEED`` lines is verified by its
inner product. A vector at the radius reaches that with a probability of 0.75, nearer ones with more. A
query is done when its k-th verified vector is within its radius; the others go on with a wider one.

Windows are differences of two prefix sets of a line, kept as bits, and the lines are added up by
carry-save adders over 64 vectors at a time, so a collision costs a fraction of an operation.

Largest inner product becomes smallest distance by one more coordinate sqrt(M^2 - |x|^2) for the
stored vectors, with M the largest norm, and 0 for queries.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

LINES, SEGMENTS = 252, 256
HIT = 0.6826894921370859            # a vector at the radius is within one radius on a line
SLACK = 0.675                       # deviations below the mean count: three in four at the radius pass
NEED = math.floor(LINES * HIT - SLACK * math.sqrt(LINES * HIT * (1 - HIT)))
#: Vectors per block and bytes of them, queries per chunk, queries counted together.
BLOCK_ROWS, BLOCK_BYTES, CHUNK, TOGETHER = 8192, 16_000_000, 8192, 64
AHEAD, GROWTH = 1.03, 1.06          # the first radius beyond the expected one; how radii grow


class Counter:
    """Bit-sliced sums: plane i holds bit i of the count of every position."""

    def __init__(self):
        self.planes: list[np.ndarray] = []

    def add(self, carry: np.ndarray, place: int) -> None:
        """Add sets worth 2 ** place."""
        while place < len(self.planes):
            self.planes[place], carry = self.planes[place] ^ carry, self.planes[place] & carry
            place += 1
        self.planes += [np.zeros_like(carry)] * (place - len(self.planes)) + [carry]

    def add_seven(self, x: list[np.ndarray]) -> None:
        """Add seven sets by four full adders, then their sum of three bits."""
        def full(a, b, c):
            ab = a ^ b
            return ab ^ c, (a & b) | (ab & c)

        s1, c1 = full(x[0], x[1], x[2])
        s2, c2 = full(x[3], x[4], x[5])
        s, c3 = full(s1, s2, x[6])
        t, f = full(c1, c2, c3)
        for place, bits in enumerate((s, t, f)):
            self.add(bits, place)

    def at_least(self, least: int) -> np.ndarray:
        """The positions whose count is ``least`` or more."""
        above = np.zeros_like(self.planes[0])
        equal = ~above
        for place in range(max(len(self.planes), least.bit_length()) - 1, -1, -1):
            bit = self.planes[place] if place < len(self.planes) else np.zeros_like(above)
            if least >> place & 1:
                equal &= bit
            else:
                above |= equal & bit
        return above | equal


class Block:
    """Sorted projections of one block of vectors of equal length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float, lines: int = LINES):
        self.ids, self.vectors, self.most = ids, vectors, most
        n = len(ids)
        rng = np.random.default_rng(3)
        self.lines = rng.standard_normal((vectors.shape[1] + 1, lines))
        rest = np.sqrt(np.maximum(most - (vectors * vectors).sum(1), 0))
        places = np.ascontiguousarray((vectors @ self.lines[:-1] + rest[:, None] * self.lines[-1]).T)
        order = np.argsort(places, axis=1, kind="stable")
        cuts = np.arange(SEGMENTS + 1) * n // SEGMENTS
        ranked = np.take_along_axis(places, order, axis=1)
        self.first = ranked[:, np.minimum(cuts[:-1], n - 1)].copy()
        self.last = ranked[:, np.maximum(cuts[1:], 1) - 1].copy()
        # One bit per vector in the part it belongs to, then all parts up to each.
        part = np.repeat(np.arange(SEGMENTS), np.diff(cuts)) + 1
        self.prefix = np.zeros((lines, SEGMENTS + 1, -(-n // 64) * 8), np.uint8)
        for j in range(lines):
            np.bitwise_or.at(self.prefix[j], (part, order[j] >> 3), (128 >> (order[j] & 7)).astype(np.uint8))
        self.prefix = self.prefix.view(np.uint64)
        np.bitwise_or.accumulate(self.prefix, axis=1, out=self.prefix)

    def candidates(self, queries: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(queries, vectors): which vectors collide often enough with each query."""
        at = queries @ self.lines[:-1]
        counter, held = Counter(), []
        for j in range(self.prefix.shape[0]):
            # Whole parts that the window touches; an empty part in a small block adds nothing.
            low = np.searchsorted(self.last[j], at[:, j] - radius)
            high = np.searchsorted(self.first[j], at[:, j] + radius, "right")
            held.append(self.prefix[j, np.maximum(high, low)] & ~self.prefix[j, low])
            if len(held) == 7:
                counter.add_seven(held)
                held = []
        for bits in held:
            counter.add(bits, 0)
        found = np.unpackbits(counter.at_least(NEED).view(np.uint8), axis=1)
        return found[:, :len(self.ids)].astype(bool)

    def search(self, own: np.ndarray, queries: np.ndarray, radius: np.ndarray, k: int):
        """(query id, vector id, inner product, verified): the k best of each query's candidates; the number
        verified stands on the first row."""
        for start in range(0, len(own), TOGETHER):
            part = slice(start, start + TOGETHER)
            for q, query, near in zip(own[part], queries[part], self.candidates(queries[part], radius[part])):
                rows = np.flatnonzero(near & (self.ids != q))
                if len(rows):
                    value = (self.vectors[rows] * query).sum(axis=1)
                    ids = self.ids[rows]
                    for place, i in enumerate(np.lexsort((ids, -value))[:k]):
                        yield int(q), int(ids[i]), float(value[i]), 0 if place else len(rows)


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v) in double precision: ids and vectors that are not null, zero or not finite."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull())
            .where(~bad & F.exists("v", lambda x: x != 0.0)))


def first_radii(asked: DataFrame, rows: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """``asked`` with base (the squared norms of query and longest vector), the first radius and the
    largest that is needed.

    The first radius is where the k-th neighbour of vectors that point everywhere alike would lie; it
    sets only where the search begins.
    """
    means = (rows.select("dim", F.posexplode("v").alias("i", "x")).groupBy("dim", "i").agg(F.avg("x").alias("x"))
             .groupBy("dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean")))
    share = {r["dim"]: NormalDist().inv_cdf(1 - min(0.5, k / max(r["n"], 2))) for r in facts.select("dim", "n").collect()}
    depth = asked.sparkSession.createDataFrame(list(share.items()), "dim int, depth double")
    dot = F.aggregate(F.zip_with("v", "mean", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    spread = F.sqrt(norm * F.greatest(F.col("square") - F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x), F.lit(0.0)) / F.col("dim"))
    base, top = norm + F.col("most"), F.sqrt(norm) + F.sqrt("most")
    found = (asked.join(F.broadcast(facts.select("dim", "most", "square")), "dim")        # one row per vector length
             .join(F.broadcast(means), "dim").join(F.broadcast(depth), "dim"))
    expected = F.sqrt(F.greatest(base - 2 * (dot + F.col("depth") * spread), 1e-6 * base))
    return found.select("dim", "id", "v", base.alias("base"), F.least(AHEAD * expected, top).alias("radius"),
                        top.alias("top"))


def search(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = 20,
           every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): the k nearest found of every query, and how many vectors
    the query's last round verified.

    Queries are the rows whose id is divisible by ``every``; candidates all rows of the same length
    but the query's own. Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do null ids. Rows that repeat an id count once, with their best score; as queries, with
    their smallest vector. Ties go to the smaller id. Blocks of bounded size meet chunks of bounded
    size, so a task's memory does not grow with the table; copies of one vector are dealt over all
    blocks by their ids. A round's unfinished queries alone enter the next.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_column, vector).withColumn("dim", F.size("v")))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = stored(rows.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.max(norm).alias("most"), F.avg(norm).alias("square"),
        F.ceil(F.count(F.lit(1)) / F.least(F.lit(BLOCK_ROWS), F.greatest(
            F.lit(k), F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))).cast("long").alias("blocks")))
    sizes = F.broadcast(facts.select("dim", "most", "blocks"))          # one row per vector length
    asked = (rows.where(F.col("id") % every == 0).groupBy("dim", "id").agg(F.min("v").alias("v")))
    asked = stored(first_radii(asked, rows, facts, k))
    done = []
    turn = 0
    while True:
        count = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("chunks"))
        counts = {r["dim"]: r["chunks"] for r in count.collect()}
        if not counts:
            break
        best = stored(_round(rows.join(sizes, "dim"), asked, counts, k))
        kth = best.groupBy(F.col("query_id").alias("id"), "dim").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last"))
        judged = asked.join(kth, ["id", "dim"], "left").withColumn("over", F.coalesce(
            (F.col("radius") >= F.col("top")) | ((F.col("n") >= k) & (F.col("base") - 2 * F.col("last") <= F.col("radius") ** 2)),
            F.lit(False)))
        judged = stored(judged)
        done.append(best.join(judged.where("over").select(F.col("id").alias("query_id"), "dim"), ["query_id", "dim"], "left_semi"))
        turn += 1
        wider = F.least(F.col("radius") * GROWTH ** (turn + 1), F.col("top"))
        asked = stored(judged.where("NOT over").select("dim", "id", "v", "base", wider.alias("radius"), "top"))
    if not done:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    # An id with vectors of several lengths is one query.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score", "verified"))


def _round(rows: DataFrame, asked: DataFrame, chunks: dict[int, int], k: int) -> DataFrame:
    """(query_id, dim, vec_id, score, verified): the k best candidates of each query at its radius."""
    spark = rows.sparkSession
    parts = spark.createDataFrame(list(chunks.items()), "dim int, chunks long")
    rows = rows.join(F.broadcast(parts), "dim")

    def upto(count):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    spread = F.pmod(F.xxhash64("id"), F.col("blocks"))
    stock = rows.select("dim", spread.alias("block"), upto("chunks").alias("chunk"), "id", "v", "most")
    sizes = rows.select("dim", "blocks", "chunks").distinct()
    near = (asked.join(F.broadcast(sizes), "dim")
            .select(F.col("dim").alias("q_dim"), upto("blocks").alias("q_block"),
                    F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")).alias("q_chunk"),
                    F.col("id").alias("q_id"), F.col("v").alias("q_v"), "radius"))
    keys, q_keys = ["dim", "block", "chunk"], ["q_dim", "q_block", "q_chunk"]

    def run(stock: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(stock) and len(near):
            block = Block(stock["id"].to_numpy(np.int64), np.stack(stock["v"]).astype(float),
                          float(stock["most"].iloc[0]))
            out = list(block.search(near["q_id"].to_numpy(np.int64), np.stack(near["q_v"]).astype(float),
                                    near["radius"].to_numpy(float), k))
        found = pd.DataFrame(out, columns=["query_id", "vec_id", "score", "verified"])
        found["dim"] = stock["dim"].iloc[0] if len(stock) else 0
        return found

    tasks = sum(r["n"] for r in sizes.select((F.col("blocks") * F.col("chunks")).alias("n")).collect())
    parallel = int(max(1, min(tasks, 100_000)))
    found = (stock.repartition(parallel, *keys).groupBy(*keys)
             .cogroup(near.repartition(parallel, *q_keys).groupBy(*q_keys))
             .applyInPandas(run, "query_id long, vec_id long, score double, verified long, dim int"))
    # Rows of an id that repeats may lie in the same block only, as blocks follow ids.
    best = found.groupBy("query_id", "dim", "vec_id").agg(F.max("score").alias("score"), F.sum("verified").alias("work"))
    group = Window.partitionBy("query_id", "dim")
    rank = F.row_number().over(group.orderBy(F.desc("score"), "vec_id"))
    return (best.withColumn("verified", F.sum("work").over(group)).withColumn("rank", rank)
            .where(F.col("rank") <= k).select("query_id", "dim", "vec_id", "score", "verified"))
