"""Nearly equal values of a column, over all rows: an exact similarity join of the different values.

The ratio of two values of a and b characters is 200 * LCS / (a + b) with their longest common
subsequence LCS. A pair at the threshold has an LCS of at least ``needed(a, b)`` characters. No pair
is missed, whatever its lengths:

* Both values short: each is indexed by its subsequences of the lengths that the lengths in the
  table ask for. Two values are near exactly if they share one of a length that they need, so
  whether a value has a near one follows from counts per key, without pairs. A key travels with the
  smaller keys of its value, and a pair is taken at the smallest key it shares: it comes out of the join
  once, with all that is asked of it, and is not shuffled again.
* One longer: values are indexed by q-grams. At least ``c`` grams of either value stand unbroken in the
  other, so with all grams in one order both have a common one among the first |grams| - c + 1. The
  order is by rarity (counts per hash bucket, a table of fixed size), so common grams are hardly ever
  indexed. Rank, length and position of the gram are tested in the join itself.
* Both long: the ratio leaves room for a change every few characters, so hardly a gram could be left out
  of an index. Values are cut into blocks of bounded size in order of length, every block meets those whose
  lengths allow a pair, and a pair costs little: counts of characters rule most out, and one step compares a
  character with many values at once, several of them in one lane, within the places a near pair can use, until
  the rest cannot make up for the start.

Equal values are one class: rows meet their class once, and pairs are formed between classes only, so
output is linear in rows plus links between different values.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..session import stored
from .table import Table

SHORT, VARIANTS = 20, 2000      # longest value known by subsequences, and most subsequences of one value
LONG = 200                      # pairs of values from this length on are compared block by block
GRAM = 3                        # characters of an indexed gram, fewer for low thresholds
FEW = 64                        # a value with more subsequences does not carry them; its pairs are made distinct
BUCKETS = 1 << 20               # counts that order the grams
LONG_PAIR = 500                 # longer pairs are tested by grams instead of the edit distance
BLOCK, BLOCK_CHARS = 2048, 8 << 20      # most values and characters of a block, unless one value is longer
PARTS = 24                      # blocks that a small table is cut into
STEPS = 1000                    # steps of length that blocks are made of, for a length e times as long
STARTS = (0.25, 0.35, 0.5)      # shares of a value that are compared with many at once, before the whole value
OWN, GROUPS = 224, 64           # characters that are told apart in a block, and groups of them that are counted
GROUP_OF = np.array([0] + [k if k < 48 else 48 + k % 16 for k in range(255)], np.uint8)
RUN, ALIKE = 1.1, 0.2           # longest to shortest value of a run, and the most that shares of characters differ in it
LANES, LANE_CHARS = 512, 1 << 19        # most values that are compared at once, and their characters
GROUP, ALONE, SINGLE = 3, 256, 3        # values of a lane; most lanes of one value each; values that are compared one by one
CARRIED = 2                     # bytes above a lane
SHARED = 8                      # values from which on they share masks
SALT = 0x2545F491


def needed(a: int, b: int, threshold: float) -> int:
    """Length of the common subsequence that values of these lengths need."""
    return math.ceil(threshold / 200 * (a + b) - 1e-9)


def _needed(a: str, b: str, threshold: float) -> str:
    return f"CAST(ceil({threshold / 200} * ({a} + {b}) - 1e-9) AS INT)"


def _kept_lengths(size: int, lengths, threshold: float) -> set[int]:
    """Lengths of the subsequences by which a value of ``size`` meets values of ``lengths``."""
    return {m for n in lengths if (m := needed(size, n, threshold)) <= min(size, n)}


def exact_limit(threshold: float) -> int:
    """The greatest length up to SHORT of which a value has at most VARIANTS subsequences as keys."""
    def keys(size):
        return sum(math.comb(size, m) for m in _kept_lengths(size, range(1, size + 1), threshold))
    return max((n for n in range(1, SHORT + 1) if keys(n) <= VARIANTS), default=0)


def gram_size(least: float, threshold: float, wanted: int) -> int:
    """The longest gram up to ``wanted`` of which pairs from ``least`` characters on must share one.

    A pair shares c = L - (q - 1) * (1 + a + b - 2 * L) grams at least: a deleted character breaks q
    grams, an inserted one q - 1.
    """
    share = threshold / 100
    for q in range(wanted, 1, -1):
        if least * (share - 2 * (q - 1) * (1 - share)) >= q:
            return q
    return 1


@lru_cache(maxsize=100_000)
def prefix_length(size: int, q: int, threshold: float) -> int:
    """The most grams that a value of this length is indexed by, over all lengths of its partners."""
    most = 0
    low, high = math.floor(size * threshold / (200 - threshold)), math.ceil(size * (200 - threshold) / threshold)
    other = np.arange(max(low, 1), high + 1)
    need = np.ceil(threshold / 200 * (size + other) - 1e-9)
    other, need = other[need <= np.minimum(size, other)], need[need <= np.minimum(size, other)]
    if len(other):
        shared = need - (q - 1) * (1 + size + other - 2 * need)
        most = int((size - q + 1 - shared).max()) + 1
    return max(0, min(most, size - q + 1))


class Grams:
    """Hashes of the q-grams of a value, in order of their places."""

    def __init__(self, q: int):
        self.q = q

    def of(self, value: str) -> np.ndarray:
        points = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        n = len(points) - self.q + 1
        grams = np.zeros(max(n, 0), np.uint64)
        for j in range(self.q if n > 0 else 0):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + points[j:j + n] + np.uint64(1)
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(0x7FB5D329728EA185)
        return grams ^ (grams >> np.uint64(27))


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(44)).astype(np.int64)         # 2 ** 20 buckets


def classes(table: Table, column: str) -> DataFrame:
    """(h, v, size, rows, k): the different values that are not empty, with a 128-bit hash, their rows and
    the smallest row key."""
    v = F.col(f"`{column}`")
    rows = table.df.where(F.length(v) > 0).select(
        F.col(f"`{table.row_key[0]}`").alias("k"), v.alias("v"), F.unhex(F.md5(v.cast("binary"))).alias("h"))
    return (rows.groupBy("h").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("rows"), F.min("k").alias("k"))
            .select("h", "v", F.length("v").alias("size"), "rows", "k"))


def _subsequences(short: DataFrame, threshold: float) -> DataFrame:
    """``short`` with ``keys``: the subsequences of its values by two hashes, m characters long."""
    lengths = [r["size"] for r in short.select("size").distinct().collect()]     # SHORT at most
    kept = {n: sorted(_kept_lengths(n, lengths, threshold)) for n in lengths}

    def subsequences(column: pd.Series) -> pd.Series:
        return pd.Series([list({"".join(x) for m in kept[len(v)] for x in itertools.combinations(v, m)})
                          for v in column], dtype=object)

    texts = F.pandas_udf(subsequences, "array<string>")
    return short.withColumn("texts", texts("v")).withColumn("keys", F.transform("texts", lambda s: F.struct(
        F.xxhash64(s).alias("k1"), F.xxhash64(F.lit(SALT), s).alias("k2"), F.length(s).alias("m")))).drop("texts")


def _gram_counts(values: DataFrame, q: int) -> np.ndarray:
    """Occurrences of the grams per hash bucket: partial counts per task, then one number a bucket."""
    grams, bucket, buckets = Grams(q), _bucket, BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for v in batch.column("v").to_pylist():
                np.add.at(counts, bucket(grams.of(v)), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    partial = values.select("v").mapInArrow(run, "bucket long, n long")
    found = partial.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()       # BUCKETS rows at most
    counts = np.zeros(BUCKETS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def _prefixes(values: DataFrame, q: int, threshold: float) -> DataFrame:
    """(g, h, size, r, p): the rarest grams of each value with rank and place; grams that no other
    value can hold are left out."""
    spark = values.sparkSession
    known = spark.sparkContext.broadcast(_gram_counts(values, q))
    grams, bucket, length_of = Grams(q), _bucket, prefix_length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known.value
        for batch in batches:
            hashes, sizes, held = batch.column("h"), batch.column("size").to_pylist(), []
            for i, v in enumerate(batch.column("v").to_pylist()):
                found = grams.of(v)
                n = counts[bucket(found)]
                order = np.lexsort((np.arange(len(found)), found, n))[:length_of(sizes[i], q, threshold)]
                rank = np.flatnonzero(n[order] > 1)
                place = order[rank]
                held.append((found[place], np.full(len(place), i), np.full(len(place), sizes[i]), rank, place))
                if len(held) >= 512 or len(place) > 100_000:
                    yield rows_of(held, hashes)
                    held = []
            if held:
                yield rows_of(held, hashes)

    def rows_of(held, hashes):
        g, i, size, r, p = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays(
            [pa.array(g.view(np.int64)), hashes.take(pa.array(i)), pa.array(size.astype(np.int32)),
             pa.array(r.astype(np.int32)), pa.array(p.astype(np.int32))], ["g", "h", "size", "r", "p"])

    return values.select("h", "v", "size").mapInArrow(run, "g long, h binary, size int, r int, p int")


def _gram_pairs(entries: DataFrame, q: int, threshold: float, which: str) -> DataFrame:
    """(h, h2) of values that share an indexed gram where rank, lengths and places allow the threshold.

    Lengths are cut into bands as wide as a pair's lengths can differ, so a value meets those of its own
    band and of the one below.
    """
    stretch = (200 - threshold) / threshold * (1 + 1e-9)
    entries = entries.withColumn("band", F.floor(F.log("size") / math.log(stretch)).cast("int"))
    one = entries.alias("x")
    two = entries.withColumn("met", F.explode(F.array("band", F.col("band") - 1))).alias("y")
    need = _needed("x.size", "y.size", threshold)
    shared = f"({need} - {q - 1} * (1 + x.size + y.size - 2 * {need}))"
    allowed = " AND ".join([
        "x.g = y.g", "x.band = y.met", "(x.band < y.band OR x.h < y.h)", which, f"{need} <= least(x.size, y.size)",
        f"x.r <= x.size - {q - 1} - {shared}", f"y.r <= y.size - {q - 1} - {shared}",
        f"x.p - y.p <= x.size - {need}", f"y.p - x.p <= y.size - {need}"])
    return one.join(two, F.expr(allowed)).select(F.least("x.h", "y.h").alias("h"), F.greatest("x.h", "y.h").alias("h2"))


class Compared:
    """One value against many: the longest common subsequence of those that are near enough.

    A pair with ``need`` common characters leaves at most size - need of either unmatched, so the places of
    two matched characters differ by no more. Rows are taken in strips over the places that these can reach.
    """

    def __init__(self, value: str):
        self.size, points = len(value), np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
        self.places = {ch: int.from_bytes(np.packbits(points == ord(ch), bitorder="little").tobytes(), "little")
                       for ch in set(value)}

    def common(self, other: str, need: int) -> int:
        """Length of the longest common subsequence if it is ``need`` at least, else -1."""
        n, m = self.size, len(other)
        if need > min(n, m):
            return -1
        strip = max(64, m // 16)
        # Bit i of a row is 0 where the subsequence grows with character low + i; ``passed`` counts those below.
        row = passed = low = high = 0
        for start in range(0, m, strip):
            end = min(start + strip, m)
            shift, top = max(0, start - (m - need)) - low, min(n, end + n - need)
            passed += shift - (row & ((1 << shift) - 1)).bit_count()
            row, low = row >> shift, low + shift
            row |= (1 << (top - low)) - (1 << (high - low))
            high, full = top, (1 << (top - low)) - 1
            part = other[start:end]
            masks = {ch: (self.places.get(ch, 0) >> low) & full for ch in set(part)}
            for mask in map(masks.__getitem__, part):
                hit = row & mask
                row = (row + hit) | (row ^ hit)     # what is carried beyond the strip meets no mask
            row, width = row & full, high - low
            bits = np.unpackbits(np.frombuffer(row.to_bytes((width + 7) // 8, "little"), np.uint8),
                                 bitorder="little", count=width)
            grown = np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))
            rest = np.minimum(n - low - np.arange(width + 1), m - end)
            if passed + int((grown + rest).max()) < need:
                return -1
        return passed + (high - low) - row.bit_count()


def _starts_agree(value: str, codes: list[np.ndarray], alphabet: dict[str, int], need: np.ndarray,
                  share: float) -> np.ndarray:
    """Which of the values, given as codes of characters, can still reach ``need`` common characters with
    ``value`` once its first ``share`` of characters is compared.

    All values stand side by side in one row of bits, each with a bit above it that stops the carry, so
    that a character of ``value`` is one step for all of them.
    """
    n, sizes = len(value), np.array([len(c) for c in codes])
    start = math.ceil(n * share)
    width = int(np.minimum(sizes, start + sizes - need).max())
    placed = np.zeros((len(codes), width + 1), codes[0].dtype)
    for i, c in enumerate(codes):
        placed[i, :min(width, len(c))] = c[:width]

    def number(bits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(bits, axis=None, bitorder="little").tobytes(), "little")

    lanes = np.ones(placed.shape, bool)
    lanes[:, width] = False
    row = full = number(lanes)
    masks = {ch: number(placed == alphabet[ch]) if ch in alphabet else 0 for ch in set(value[:start])}
    for mask in map(masks.__getitem__, value[:start]):
        hit = row & mask
        row = ((row + hit) | (row ^ hit)) & full
    size = placed.size
    bits = np.unpackbits(np.frombuffer(row.to_bytes((size + 7) // 8, "little"), np.uint8), bitorder="little", count=size)
    grown = np.zeros(placed.shape, np.int32)
    np.cumsum(1 - bits.reshape(placed.shape)[:, :width].astype(np.int32), axis=1, out=grown[:, 1:])
    rest = np.minimum(sizes[:, None] - np.arange(width + 1), n - start)
    return (grown + rest).max(axis=1) >= need


class Side:
    """The values of a block as kinds of characters, with their counts by a few groups of kinds."""

    def __init__(self, values: list[str], points: list[np.ndarray], kinds: np.ndarray):
        self.values, self.codes = values, [kinds[p] for p in points]
        self.sizes = np.array([len(c) for c in self.codes], np.int64)
        self.counts = np.array([np.bincount(GROUP_OF[c], minlength=GROUPS) for c in self.codes], np.float32)
        self.order = np.argsort(self.sizes, kind="stable")
        self.compared = lru_cache(maxsize=4096)(lambda i: Compared(self.values[i]))

    def runs(self, some: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """The values ``some``, in order of length, cut where a run would get too long or its lengths too different."""
        start = 0
        while start < len(some):
            high = np.searchsorted(self.sizes[some], self.sizes[some[start]] * RUN)
            end = max(start + 1, min(int(high), start + most))
            yield some[start:end]
            start = end

    def lanes(self) -> Iterator[np.ndarray]:
        """All values in runs of like lengths and like characters, so that most of a run is ruled out together."""
        shares, left = self.counts / self.sizes[:, None], self.order
        for last in [False] * 15 + [True]:
            if len(left):
                like = np.abs(shares[left] - shares[left[len(left) // 2]]).sum(axis=1) <= ALIKE
                like |= last
                size = int(np.median(self.sizes[left[like]]))
                yield from self.runs(left[like], min(LANES, max(8 * GROUP, LANE_CHARS // size)))
                left = left[~like]


def _sides(blocks: list[list[str]]) -> tuple[list[Side], bool]:
    """The blocks in kinds of characters, and whether every character is a kind of its own: the rarest of more than
    OWN share kinds, so that no common subsequence gets shorter."""
    points = [[np.frombuffer(v.encode("utf-32-le", "surrogatepass"), "<u4") for v in values] for values in blocks]
    counts = np.zeros(0x110000, np.int64)
    for p in itertools.chain(*points):
        found = np.bincount(p)
        counts[:len(found)] += found
    used = np.flatnonzero(counts)
    rank = np.empty(len(used), np.int64)
    rank[np.argsort(-counts[used], kind="stable")] = np.arange(len(used))
    kinds = np.zeros(0x110000, np.uint8)
    kinds[used] = 1 + np.where(rank < OWN, rank, OWN + rank % (255 - OWN))
    return [Side(values, p, kinds) for values, p in zip(blocks, points)], len(used) <= OWN


class Lanes:
    """Values in lanes of one long number, ``group`` of like length to a lane, for comparison with values that are not longer.

    Bit i of a lane is 0 where the common subsequence grows with character low + i. A row is one step for all lanes;
    what it carries out of a lane stays in the bits above it. In a lane with several values a place holds the characters of all
    of them, so none has more in common than the lane. Rows are taken in strips over the places that ``dels`` left out
    characters of a row's value and ``adds`` of a lane's can reach, so the masks of a strip serve all the rows.
    """

    def __init__(self, codes: list[np.ndarray], group: int, longest: int, dels: int, adds: int):
        self.group, self.lanes = group, -(-len(codes) // group)
        self.sizes = self._by_lane(np.array([len(c) for c in codes]), 0)
        self.top = -(-int(self.sizes.max()) // 8) * 8
        self.placed = np.zeros((self.lanes * group, self.top), np.uint8)
        for row, c in zip(self.placed, codes):
            row[:len(c)] = c
        self.placed = self.placed.reshape(self.lanes, group, self.top)
        self.strip = min(4096, max(16, longest // (320 if self.lanes >= 128 else 160) * 8))
        self.dels, self.adds, self.masks = dels, adds, {}

    def _by_lane(self, of_values: np.ndarray, missing: int) -> np.ndarray:
        held = np.full(self.lanes * self.group, missing, np.int64)
        held[:len(of_values)] = of_values
        return held.reshape(self.lanes, self.group).max(axis=1)

    def _window(self, start: int) -> tuple[int, int]:
        low, high = max(0, start - self.dels) // 8 * 8, -(-(start + self.strip + self.adds) // 8) * 8
        return min(low, self.top - 8), min(high, self.top)

    def _number(self, bits: np.ndarray) -> int:
        """The bytes of all lanes, each with room for what is carried out of it."""
        held = np.zeros((len(bits), bits.shape[1] + CARRIED), np.uint8)
        held[:, :-CARRIED] = bits
        return int.from_bytes(held.tobytes(), "little")

    def _mask(self, known: dict, start: int, kind: int) -> tuple[int, int] | None:
        """The places of a kind of character in the lanes, and all others."""
        low, high = self._window(start)
        at = np.packbits((self.placed[:, :, low:high] == kind).any(axis=1), axis=1, bitorder="little")
        known[kind] = (self._number(at), self._number(~at)) if at.any() else None
        return known[kind]

    def common(self, code: np.ndarray, left: np.ndarray, dels: np.ndarray, until: float) -> tuple[np.ndarray | None, np.ndarray]:
        """Of the values marked in ``left``, those for which no more than ``dels`` characters of ``code`` must be left out
        as far as it is compared, and per lane the characters in common if it was compared to its end, which it is up to the
        share ``until`` at most.

        With p characters of one and e of the other behind it, a near pair has left out fewer than it may in
        all; no e asks for less than p + (difference of lengths).
        """
        n, allowed = len(code), self._by_lane(np.where(left, dels, -1), -1)
        low, high = self._window(0)
        bits, passed, every = np.full((self.lanes, (high - low) // 8), 255, np.uint8), np.zeros(self.lanes, np.int64), np.arange(self.lanes)
        least = 3 * allowed[allowed >= 0].min() // 2         # hardly a value is ruled out sooner
        for start in range(0, n, self.strip):
            low2, high2 = self._window(start)
            if start:
                shift = (low2 - low) // 8
                if shift:
                    passed += 8 * shift - np.bitwise_count(bits[:, :shift]).sum(axis=1, dtype=np.int64)
                kept = bits[:, shift:]
                bits = np.full((self.lanes, (high2 - low2) // 8), 255, np.uint8)
                bits[:, :kept.shape[1]] = kept
            low, high, part = low2, high2, code[start:start + self.strip].tolist()
            known = self.masks.setdefault(start, {})
            masks = {k: known[k] if k in known else self._mask(known, start, k) for k in set(part)}
            row = self._number(bits)
            for found in map(masks.__getitem__, part):
                if found:
                    row = (row + (row & found[0])) | (row & found[1])
            held = np.frombuffer(row.to_bytes(self.lanes * ((high - low) // 8 + CARRIED), "little"), np.uint8)
            bits = held.reshape(self.lanes, -1)[:, :-CARRIED]
            done = start + len(part)
            if done < min(least, n):
                continue
            zeros = 8 - np.bitwise_count(bits)
            upto = np.minimum(np.maximum((done + self.sizes - n - low + 7) // 8, 1), zeros.shape[1]) - 1
            allowed[done - passed - np.cumsum(zeros, axis=1, dtype=np.int32)[every, upto] > allowed] = -1
            open_ = np.count_nonzero(allowed >= 0)
            if not open_ or done < n and (done >= until * n or open_ <= 2 and done >= 0.6 * until * n):
                break
        left = left & np.repeat(allowed >= 0, self.group)[:len(left)]
        return (passed + zeros.sum(axis=1, dtype=np.int64) if done == n else None), left


def _length_need(one: np.ndarray, two: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold / 200 * (one + two) - 1e-9).astype(np.int64)


def _possible(one: Side, rows: np.ndarray, two: Side, lanes: np.ndarray, ties: str, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of these values lengths and counts of characters leave open, and what they need in common.
    The first value of a pair is the shorter one."""
    n, m = one.sizes[rows][:, None], two.sizes[lanes][None, :]
    need = _length_need(n, m, threshold)
    open_ = n < m
    if ties != "none":
        open_ |= (n == m) & ((rows[:, None] < lanes[None, :]) | (ties == "all"))
    open_ &= need <= n
    counts, every = two.counts[lanes], np.ones(GROUPS, np.float32)
    for i in np.flatnonzero(open_.any(axis=1)):
        open_[i] &= np.minimum(one.counts[rows[i]], counts) @ every >= need[i]
    return open_, need


def _starts_left(value: str, others: list[str], need: np.ndarray) -> np.ndarray:
    """Which of the others can still be near when the starts of ``value`` are compared with all of them."""
    alphabet = {ch: k for k, ch in enumerate(sorted(set(value)), 1)}
    codes = [np.array([alphabet.get(ch, 0) for ch in v], np.uint32) for v in others]
    left = np.arange(len(others))
    for share in STARTS:
        if len(left):
            left = left[_starts_agree(value, [codes[j] for j in left], alphabet, need[left], share)]
    return left


def _near(one: Side, two: Side, ties: str, own: bool, threshold: float) -> Iterator[tuple]:
    """(i, j, ratio) of the near pairs whose first value is the shorter one."""
    stretch = (200 - threshold) / threshold * (1 + 1e-9)
    for lanes in two.lanes():
        shortest, longest = two.sizes[lanes[0]], two.sizes[lanes[-1]]
        some = one.order[(one.sizes[one.order] <= longest) & (one.sizes[one.order] * stretch + 1 >= shortest)]
        for rows in one.runs(some, len(some)):
            yield from _near_in_run(one, rows, two, lanes, ties, own, threshold)


def _near_in_run(one: Side, rows: np.ndarray, two: Side, lanes: np.ndarray, ties: str, own: bool, threshold: float) -> Iterator[tuple]:
    """``_near`` for values of like length: first with several of a run at once, then with those that are left."""
    open_, need = _possible(one, rows, two, lanes, ties, threshold)
    busy = np.flatnonzero(open_.any(axis=1))
    if not len(busy):
        return
    n, m = one.sizes[rows], two.sizes[lanes]
    dels, shared = n[:, None] - need, len(busy) >= SHARED
    codes, reach = [two.codes[j] for j in lanes], (int(n[busy].max()), int(dels[open_].max()), int((m - need)[open_].max()))
    at_once, single = Lanes(codes, GROUP, *reach) if shared else None, {}
    for i in busy.tolist():
        value, code, left, found = one.values[rows[i]], one.codes[rows[i]], open_[i], {}
        if shared and np.count_nonzero(left) > SINGLE:
            left = at_once.common(code, left, dels[i], 0.5)[1]
            for k in range(0, len(lanes), ALONE) if np.count_nonzero(left) > SINGLE else ():
                part = slice(k, k + ALONE)
                if left[part].any():
                    if k not in single:
                        single[k] = Lanes(codes[part], 1, *reach)
                    common, left[part] = single[k].common(code, left[part], dels[i, part], 1.0)
                    if common is not None and own:
                        found.update((k + j, int(common[j])) for j in np.flatnonzero(left[part]).tolist())
        left = np.flatnonzero(left)
        if not shared and len(left) > SINGLE:
            left = left[_starts_left(value, [two.values[j] for j in lanes[left]], need[i][left])]
        compared = one.compared(rows[i]) if len(found) < len(left) else None
        for j in left.tolist():
            common = found[j] if j in found else compared.common(two.values[lanes[j]], int(need[i, j]))
            ratio = 200.0 * common / (n[i] + m[j])
            if common >= need[i, j] and threshold <= ratio < 100:
                yield int(rows[i]), int(lanes[j]), float(ratio)


def _near_in_block(one: list[str], two: list[str], same: bool, threshold: float) -> Iterator[tuple]:
    """(i, j, ratio) of the near pairs of two blocks, or of the different values of one."""
    if not one or not two:
        return
    (side, *others), own = _sides([one] if same else [one, two])
    if same:
        yield from _near(side, side, "once", own, threshold)
    else:
        yield from _near(side, others[0], "all", own, threshold)
        yield from ((i, j, ratio) for j, i, ratio in _near(others[0], side, "none", own, threshold))


def _blocks(sizes: list[tuple[int, int, int, int]], stretch: float) -> list[tuple]:
    """(step, block, parts, first, last) from (step, values, least, greatest length) of all steps of length: the blocks
    that a step's values are dealt to from ``block`` on, and the first and last block that those meet."""
    chars = sum(n * high for _, n, _, high in sizes)
    room = max(BLOCK_CHARS // 64, min(BLOCK_CHARS, chars // PARTS))
    blocks, dealt = [], []         # of blocks: lengths and free room
    held = 0.0
    for step, n, low, high in sizes:
        share = n * max(1 / BLOCK, high / room)         # of a block, in values or characters
        parts = math.ceil(share)
        if parts == 1 and blocks and held + share <= 1:
            held += share
            blocks[-1] = (blocks[-1][0], high)
        else:
            held = share if parts == 1 else 1.0
            blocks += [(low, high)] * parts
        dealt.append((step, len(blocks) - parts, parts))
    lows, highs = (np.array([x[k] for x in blocks]) for k in (0, 1))
    first = np.searchsorted(highs, lows / stretch - 1).tolist()
    last = (np.searchsorted(lows, highs * stretch + 1, side="right") - 1).tolist()
    return [(step, at, parts, first[at], last[at]) for step, at, parts in dealt]


def block_pairs(values: DataFrame, least: int, threshold: float) -> DataFrame:
    """(h, h2, ratio): the near pairs of values of ``least`` characters at least.

    Blocks follow each other in order of length. A value goes to every pair of blocks that its own block is in;
    each pair of blocks is one group of bounded size, whatever the table.
    """
    spark = values.sparkSession
    stretch = (200 - threshold) / threshold * (1 + 1e-9)
    stepped = (values.where(F.col("size") >= least).select("h", "v", "size")
               .withColumn("step", F.floor(F.log("size") * STEPS).cast("int")))
    sizes = stepped.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("low"), F.max("size").alias("high"))
    blocks = _blocks(sorted(tuple(r) for r in sizes.collect()), stretch)     # STEPS rows for a length e times as long
    groups = sum({at + k: last - at - k + 1 for _, at, parts, _, last in blocks for k in range(parts)}.values())
    shape = "step int, at int, parts int, first int, last int"
    placed = (stepped.join(F.broadcast(spark.createDataFrame(blocks, shape)), "step")
              .withColumn("own", F.expr("at + CAST(pmod(xxhash64(h), parts) AS INT)")))
    placed = placed.withColumn("to", F.explode(F.expr(
        "transform(sequence(first, last), t -> struct(least(own, t) AS s, greatest(own, t) AS t, IF(t < own, 1, 0) AS side))")))
    near = _near_in_block

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        same, side = key[0].as_py() == key[1].as_py(), rows.column("side").to_numpy()
        one, two = (rows.filter(pa.array(side == s)) for s in (0, 0 if same else 1))
        found = list(near(one.column("v").to_pylist(), two.column("v").to_pylist(), same, threshold))
        i, j, ratio = (list(x) for x in zip(*found)) if found else ([], [], [])
        hs = [x.column("h").combine_chunks().take(pa.array(at, pa.int64())) for x, at in ((one, i), (two, j))]
        return pa.table({"h": hs[0], "h2": hs[1], "ratio": pa.array(ratio, pa.float64())})

    pairs = (placed.select("to.*", "h", "v").repartition(max(1, min(4 * groups, 2000)), "s", "t")
             .groupBy("s", "t").applyInArrow(run, "h binary, h2 binary, ratio double"))
    return pairs.select(F.least("h", "h2").alias("h"), F.greatest("h", "h2").alias("h2"), "ratio")


def shares_grams(left: Column | str, right: Column | str, threshold: float, q: int = 3) -> Column:
    """Whether the values share as many q-grams as the threshold asks for; false rules the pair out."""
    make = Grams(q)

    def test(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        known: dict[str, tuple] = {}

        def grams(v):
            if v not in known:
                known[v] = np.unique(make.of(v), return_counts=True)
            return known[v]

        out = []
        for a, b in zip(lefts, rights):
            total = len(a) + len(b)
            need = math.ceil(threshold / 200 * total - 1e-9)
            wanted = need - (q - 1) * (1 + total - 2 * need)
            if wanted > 0:
                (g, n), (g2, n2) = grams(a), grams(b)
                _, i, j = np.intersect1d(g, g2, assume_unique=True, return_indices=True)
                out.append(bool(np.minimum(n[i], n2[j]).sum() >= wanted))
            else:
                out.append(True)
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(test, "boolean")(left, right)


def nearly_equal(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (v, v2) of different values with a ratio of at least the threshold, and the ratio.

    Pairs that lengths, edit distance or, for long ones, grams rule out do not reach the comparison.
    """
    a, b = F.length("v"), F.length("v2")
    # Insertions and deletions are at least as many as edits, so too many edits rule a pair out.
    edits = f"CAST(floor({(100 - threshold) / 100} * (length(v) + length(v2)) + 1e-9) AS INT)"
    long = f"length(v) + length(v2) > {LONG_PAIR}"
    possible = pairs.where((F.col("v") != F.col("v2"))
                           & (F.lit(200.0) * F.least(a, b) >= threshold * (a + b)))
    possible = possible.where(F.expr(f"{long} OR levenshtein(v, v2, {edits}) >= 0"))
    short = possible.where(f"NOT ({long})")
    rest = possible.where(long).where(shares_grams("v", "v2", threshold))
    return (short.unionByName(rest).withColumn("ratio", text.indel_ratio("v", "v2"))
            .where((F.col("ratio") >= threshold) & (F.col("ratio") < 100)))


class SimilarValues:
    """The exact join over the values of one column; every table it makes is written once."""

    def __init__(self, table: Table, column: str, threshold: float = 90.0):
        self.threshold, self.limit = threshold, exact_limit(threshold)
        self.table, self.column = table, column
        self.values = stored(classes(table, column))
        self._keyed = None

    @property
    def keyed(self) -> DataFrame:
        """The short values with their subsequences."""
        if self._keyed is None:
            short = self.values.where(F.col("size") <= self.limit)
            self._keyed = stored(_subsequences(short, self.threshold))
        return self._keyed

    @property
    def keys(self) -> DataFrame:
        """(k1, k2, m, h, size): one row per subsequence of a short value."""
        return self.keyed.select(F.inline("keys"), "h", "size")

    def short_pairs(self) -> DataFrame:
        """(x, y, m): near pairs of short values, each once; both as (h, size, k, v, rows), and the length of the
        common subsequence that they need.

        A pair of values that carry their keys is taken at the smallest key of that length it shares.
        """
        key = F.col("key")
        below = F.when(F.size("keys") <= FEW, F.transform(
            F.filter("keys", lambda o: (o["m"] == key["m"]) & (o["k1"] < key["k1"])), lambda o: o["k1"]))
        entries = self.keyed.select("*", F.explode("keys").alias("key")).select(
            "key.k1", "key.k2", "key.m", below.alias("below"), "h", "size", "k", "v", "rows")
        # The written values are much smaller than their keys, so their size must not choose a broadcast.
        one, two = entries.alias("x"), entries.hint("merge").alias("y")
        met = one.join(two, F.expr("x.k1 = y.k1 AND x.k2 = y.k2 AND x.m = y.m AND x.h < y.h AND "
                                   f"x.m = {_needed('x.size', 'y.size', self.threshold)}"))
        carried = F.expr("x.below IS NOT NULL AND y.below IS NOT NULL")
        shape = [F.struct(*[f"{side}.{c}" for c in ("h", "size", "k", "v", "rows")]).alias(side) for side in "xy"]
        first = met.where(carried & ~F.expr("arrays_overlap(x.below, y.below)")).select(*shape, F.col("x.m").alias("m"))
        if self.keyed.where(F.size("keys") > FEW).isEmpty():
            return first
        rest = met.where(~carried).select(F.col("x.h").alias("h"), F.col("y.h").alias("h2"), *shape, F.col("x.m").alias("m"))
        return first.unionByName(rest.dropDuplicates(["h", "h2"]).drop("h", "h2"))

    def short_ratios(self) -> DataFrame:
        """(x, y, ratio) of ``short_pairs``. Different values share all characters of the shorter one at most, one
        less if both are as long: where they need that many, the ratio is known."""
        a, b = F.col("x.size"), F.col("y.size")
        pairs = self.short_pairs().withColumn("known", F.col("m") == F.least(a, b) - (a == b).cast("int"))
        known = pairs.where("known").withColumn("ratio", F.lit(200.0) * F.col("m") / (a + b))
        if self._ratios_known():
            return known.select("x", "y", "ratio")
        open_ = pairs.where("NOT known").withColumn("ratio", text.indel_ratio("x.v", "y.v"))
        return known.unionByName(open_).select("x", "y", "ratio")

    def _ratios_known(self) -> bool:
        """Whether the ratio of all short pairs follows from their lengths."""
        sizes = [r["size"] for r in self.keyed.select("size").distinct().collect()]      # SHORT at most
        return all(needed(a, b, self.threshold) >= min(a, b) - (a == b) for a in sizes for b in sizes)

    def long_candidates(self) -> DataFrame | None:
        """Candidates with a value beyond the limit of the subsequences and one that is not long."""
        stretch = (200 - self.threshold) / self.threshold
        size, top = F.col("size"), self.values.agg(F.max("size")).first()[0] or 0
        least = self.limit / stretch
        if top <= max(self.limit, least - 1):
            return None
        middle = (size >= math.floor(least)) & (size <= math.ceil(LONG * stretch))
        q = gram_size(max(least, 1), self.threshold, GRAM)
        entries = stored(_prefixes(self.values.where(middle), q, self.threshold))
        return _gram_pairs(entries, q, self.threshold,
                           f"greatest(x.size, y.size) > {self.limit} AND least(x.size, y.size) < {LONG}")

    def _confirmed(self, candidates: DataFrame) -> DataFrame:
        pairs = stored(candidates.distinct())
        one = self.values.select("h", "v")
        two = self.values.select(F.col("h").alias("h2"), F.col("v").alias("v2"))
        return nearly_equal(pairs.join(one, "h").join(two, "h2"), self.threshold).select("h", "h2", "ratio")

    def long_pairs(self) -> DataFrame | None:
        """(h, h2, ratio): near pairs with a value beyond the limit of the subsequences; none without such values."""
        candidates = self.long_candidates()
        if candidates is None:
            return None
        found = self._confirmed(candidates)
        if not self.values.where(F.col("size") >= LONG).isEmpty():
            found = found.unionByName(block_pairs(self.values, LONG, self.threshold))
        return stored(found)

    def pairs(self) -> DataFrame:
        """(h, h2, ratio): all pairs of different values at the threshold."""
        short, further = self.short_ratios().select(F.col("x.h").alias("h"), F.col("y.h").alias("h2"), "ratio"), self.long_pairs()
        return short if further is None else short.unionByName(further)

    def linked(self) -> DataFrame:
        """(h,): the values that have a near one.

        A short value has one if another value under one of its keys is short enough to need no longer
        key: the least size of the others decides, so hot keys are two counts, not pairs.
        """
        keys = ["k1", "k2", "m"]
        least = (self.keys.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("n"))
                 .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("s"))
                 .select(*keys, F.col("s")[0]["size"].alias("least"),
                         F.when(F.col("s")[0]["n"] > 1, F.col("s")[0]["size"]).otherwise(F.get("s", F.lit(1))["size"])
                         .alias("second")).where("second IS NOT NULL"))
        met = self.keys.join(least, keys).withColumn(
            "other", F.when(F.col("size") == F.col("least"), F.col("second")).otherwise(F.col("least")))
        short = met.where(F.expr(f"m >= {_needed('size', 'other', self.threshold)}")).select("h")
        found = self.long_pairs()
        if found is not None:
            short = short.unionByName(found.select(F.explode(F.array("h", "h2")).alias("h")))
        return short.distinct()

    def links(self) -> DataFrame:
        """(left_key, right_key, left_value, right_value, ratio, left_rows, right_rows): near values, each by
        the smallest row key that holds it, the smaller key first."""
        cells = [F.struct(*[F.col(f"{side}.{c}") for c in ("k", "v", "rows")]).alias(side) for side in "xy"]
        both, further = self.short_ratios().select("ratio", *cells), self.long_pairs()
        if further is not None:
            one = self.values.select("h", F.struct("k", "v", "rows").alias("x"))
            two = self.values.select(F.col("h").alias("h2"), F.struct("k", "v", "rows").alias("y"))
            both = both.unionByName(further.join(one, "h").join(two, "h2").select("ratio", "x", "y"))
        low, high = F.least("x", "y"), F.greatest("x", "y")
        return both.select(low["k"].alias("left_key"), high["k"].alias("right_key"), low["v"].alias("left_value"),
                           high["v"].alias("right_value"), "ratio", low["rows"].alias("left_rows"),
                           high["rows"].alias("right_rows"))

    def members(self) -> DataFrame:
        """(row key, class_key, class_rows, links, near_rows): every row with a value: the smallest row key of its
        value, the rows that have it, the near values and the rows that have those.

        Pairs are counted where they are found; only counts per value are shuffled."""
        def end(of: str, other: str) -> Column:
            return F.struct(F.col(f"{of}.h").alias("h"), F.col(f"{other}.rows").alias("rows"))

        ends, further = self.short_pairs().select(F.inline(F.array(end("x", "y"), end("y", "x")))), self.long_pairs()
        if further is not None:
            both = further.select("h", F.col("h2").alias("o")).unionByName(further.select(F.col("h2").alias("h"), F.col("h").alias("o")))
            ends = ends.unionByName(both.join(self.values.select(F.col("h").alias("o"), "rows"), "o").select("h", "rows"))
        near = ends.groupBy("h").agg(F.count(F.lit(1)).alias("links"), F.sum("rows").alias("near_rows"))
        facts = self.values.select("h", F.col("k").alias("class_key"), F.col("rows").alias("class_rows")).join(near, "h", "left")
        v = F.col(f"`{self.column}`")
        rows = self.table.df.where(F.length(v) > 0).select(*self.table.row_key, F.unhex(F.md5(v.cast("binary"))).alias("h"))
        return rows.join(facts, "h").drop("h").na.fill(0, ["links", "near_rows"])
