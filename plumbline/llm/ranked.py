"""Ranked lexical search: item weights times document impacts, as dense float64 products of tiles.

The terms of a block of items are numbered, which gives a compact vocabulary. One pass over the whole
texts counts these terms in every document and stores the sparse counts; document frequencies are partial
counts of them. A second pass multiplies tiles: an item tile (items by terms, weight times
occurrences) and a document tile (terms by documents, impacts). All entries are whole numbers and a
tile's sums stay below 2 ** 53, so float64 products are exact; sums over tiles are 64-bit integers.
Each tile's best documents are kept with all ties decided by the smaller id, then those of all tasks meet.

Items are a stated query set: they are read in order of their ids as a stream, cut into blocks of at most
``TERMS`` different terms (or one item), and each block meets all documents. Only a block reaches the
driver and the tasks at a time.

Defined results: a text that is null or has no term is in no count and is not found; items without a
term have no results; every row of items is an item of its own, so rows with one id repeat ranks;
documents without an id count and are found, before others on ties, and rows with one id are found each;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import BATCH_BYTES, map_texts, stored

TOP = 10
TERMS = 1 << 16             # different terms in a block of items
LONGEST = 1 << 20           # occurrences in a block of items
TILE_TERMS, TILE_DOCUMENTS = 1024, 2048
EXACT = 2 ** 53             # whole numbers up to here are exact in float64
IMPACT = 1_000_000          # impacts are below 10 ** 9 / 1000
#: Letters and digits of ASCII and everything beyond it; A-Z become lower case, the rest blanks.
TABLE = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32
              for i in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(TABLE)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + BATCH_BYTES)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, counts): all terms of the text, and those of the vocabulary with their occurrences."""
    spark = docs.sparkSession
    known, cut = spark.sparkContext.broadcast(vocabulary), terms

    def make():
        number = known.value

        def run(columns):
            out = []
            for text in columns[1]:
                n, found = 0, Counter()
                for part in cut(text):
                    n += len(part)
                    found.update(filter(number.__contains__, part))
                out.append((n, [number[t] for t in found], list(found.values())))
            return out
        return run

    return map_texts(docs, ["id", "t"], "n long, terms array<int>, counts array<long>", make)


def item_tiles(items: list[list[tuple]], weights: np.ndarray) -> list[tuple]:
    """(terms, matrix) tiles of the items' weights times occurrences.

    A tile has at most ``TILE_TERMS`` terms and no item's sum can pass 2 ** 53 in it: what an item has
    too much of a term goes to further tiles.
    """
    room = EXACT // IMPACT - 1
    by_term: dict[int, list] = {}
    for i, item in enumerate(items):
        for term, count in item:
            if weights[term] > 0:
                by_term.setdefault(term, []).append([i, int(weights[term]) * count])
    tiles, waiting = [], sorted(by_term.items())
    while waiting:
        chosen, used, later = {}, [0] * len(items), []
        for term, cells in waiting:
            taken, left = [], []
            for i, value in cells if len(chosen) < TILE_TERMS else ():
                part = min(value, room - used[i])
                used[i] += part
                if part:
                    taken.append((i, part))
                if part < value:
                    left.append([i, value - part])
            if len(chosen) >= TILE_TERMS:
                left = cells
            if taken:
                chosen[term] = taken
            if left:
                later.append((term, left))
        matrix = np.zeros((len(items), len(chosen)))
        for column, taken in enumerate(chosen.values()):
            for i, value in taken:
                matrix[i, column] = value
        tiles.append((np.fromiter(chosen, np.int64), matrix))
        waiting = later
    return tiles


class Best:
    """The best documents of each item so far: score above 0, largest first, then smallest id, no id first."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.rows = [[np.zeros(0, np.int64) for _ in range(3)] for _ in range(items)]

    def add(self, scores: np.ndarray, named: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: items by documents; ``named`` is 0 where a document has no id."""
        for i, score in enumerate(scores):
            least = self.rows[i][0][-1] if len(self.rows[i][0]) == self.top else 1
            good = np.flatnonzero(score >= max(least, 1))
            if len(good) > self.top:        # all ties with the last place stay
                last = np.partition(score[good], -self.top)[-self.top]
                good = good[score[good] >= last]
            if len(good):
                s, m, d = (np.concatenate(x) for x in zip(self.rows[i], (score[good], named[good], ids[good])))
                order = np.lexsort((d, m, -s))[:self.top]
                self.rows[i] = [s[order], m[order], d[order]]


def impacts(n: list[int], count: np.ndarray, row: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Impact of each counted term; the length part m is one whole number per document."""
    m = np.array([25 + 75 * int(x) * documents // length for x in n], np.int64)
    return 1_000_000_000 * count // (1000 * count + 8 * m[row])


def scored(sparse: DataFrame, items: list[list[tuple]], weights: np.ndarray, documents: int, length: int,
           top: int) -> DataFrame:
    """(item, id, score): the best documents of each task for each item."""
    spark = sparse.sparkSession
    tiles = spark.sparkContext.broadcast((item_tiles(items, weights), len(items)))
    best_of, impact_of, size = Best, impacts, TILE_DOCUMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, n_items = tiles.value
        best = best_of(n_items, top)
        for whole in batches:
            for start in range(0, whole.num_rows, size):
                batch = whole.slice(start, size)
                lists = batch.column("terms")
                term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                count = batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                value = impact_of(batch.column("n").to_pylist(), count, row, documents, length)
                total = np.zeros((n_items, batch.num_rows), np.int64)
                for names, matrix in blocks:
                    place = np.searchsorted(names, term)
                    place[place == len(names)] = 0
                    here = names[place] == term
                    used, column = np.unique(place[here], return_inverse=True)  # terms of the tile in these documents
                    tile = np.zeros((len(used), batch.num_rows))
                    tile[column, row[here]] = value[here]
                    total += (matrix[:, used] @ tile).astype(np.int64)
                ids = batch.column("id")
                named = np.asarray(ids.is_valid()).astype(np.int64)
                best.add(total, named, np.array([x or 0 for x in ids.to_pylist()], np.int64))
        for i, (score, named, ids) in enumerate(best.rows):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(score), pa.int32()),
                     pa.array([d if m else None for m, d in zip(named.tolist(), ids.tolist())], pa.int64()),
                     pa.array(score)], ["item", "id", "score"])

    return sparse.where("size(terms) > 0").mapInArrow(run, "item int, id long, score long")


def blocks(items: DataFrame, id_column: str, text: str) -> Iterator[list[tuple]]:
    """The items in order of their ids as lists of (id, {term: occurrences}), each list bounded in terms."""
    def make():
        def run(columns):
            out = []
            for text in columns[1]:
                found = Counter()
                for part in cut(text):
                    found.update(part)
                out.append(([t.decode("utf-8", "surrogatepass") for t in found], list(found.values())))
            return out
        return run

    cut = terms
    rows = items.select(F.col(id_column).alias("id"), F.col(text).alias("t")).orderBy(F.asc_nulls_first("id"))
    held, seen, size = [], set(), 0
    for r in map_texts(rows, ["id", "t"], "terms array<string>, counts array<long>", make).toLocalIterator():
        found = dict(zip((t.encode("utf-8", "surrogatepass") for t in r.terms), r.counts))
        if held and (len(seen | found.keys()) > TERMS or size + len(found) > LONGEST):
            yield held
            held, seen, size = [], set(), 0
        held.append((r.id, found))
        seen |= found.keys()
        size += len(found)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_column: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, id, score): the ``top`` documents of each item with a score above 0."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("t"))
    kind = items.schema[item_id].dataType.simpleString()
    result = spark.createDataFrame([], f"{item_id} {kind}, rank int, {id_column} bigint, score bigint")
    for block in blocks(items, item_id, item_text):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, found in block for t in found}))}
        sparse = stored(counted(rows, vocabulary).where("n > 0"))
        size = sparse.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        if not size["n"] or not vocabulary:
            continue
        weights = np.zeros(len(vocabulary), np.int64)
        holders = sparse.select(F.explode("terms").alias("term")).groupBy("term").count()
        for r in holders.collect():             # one row per term of the block
            weights[r["term"]] = math.floor(1000 * math.log((2 * size["n"] + 2) / (2 * r["count"] + 1)))
        numbered = [[(vocabulary[t], c) for t, c in found.items()] for _, found in block]
        found = scored(sparse, numbered, weights, size["n"], size["l"], top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"))
        ranked = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
        names = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(block)], f"item int, {item_id} {kind}")
        result = result.unionByName(ranked.join(F.broadcast(names), "item").select(
            item_id, "rank", F.col("id").alias(id_column), "score"))
    return result
