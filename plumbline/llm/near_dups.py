"""Near-duplicate groups by MinHash with tensored banding.

Two small collections of ``SUB`` sub-keys each are formed, every sub-key from ``WIDTH`` minhashes. A
table's key pairs one sub-key of the first collection with one of the second, so 2 * SUB sub-keys
give SUB * SUB tables: about the square root of the minhashes that separate tables would need.
Candidates of a table are confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import Rolling, map_texts, mix, space_words, stored

SUB, WIDTH = 9, 2
ROOM = 250_000        # shingles that one task compares
SHINGLE, PERCENT = 5, 80


class Shingles:
    """Distinct shingles of a text as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words = words
        self.rolling = Rolling(seed=9)

    def of(self, text: str | None) -> np.ndarray:
        data, starts, ends = space_words(text or "")
        if not len(starts):
            return np.zeros(0, np.uint64)
        last = max(len(starts) - self.words + 1, 1)
        first, end = starts[:last], ends[min(self.words, len(ends)) - 1:]
        hashes = self.rolling.ranges(self.rolling.prefix(data), first, end[:last])
        return np.unique(mix(hashes ^ (end[:last] - first).astype(np.uint64)))


class Signer:
    """Sub-keys of the two collections."""

    def __init__(self, sub: int = SUB, width: int = WIDTH):
        rng = np.random.default_rng(99)
        self.shape = (2, sub, width)
        self.salts = rng.integers(1, 2**64, 2 * sub * width, dtype=np.uint64) | np.uint64(1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """(2, sub) keys of a set that is not empty."""
        least = np.full(len(self.salts), 2**64 - 1, np.uint64)
        for start in range(0, len(hashes), 4096):
            part = hashes[start:start + 4096]
            values = (part[None, :] ^ (part >> np.uint64(29))[None, :]) * self.salts[:, None]
            values ^= values >> np.uint64(32)
            np.minimum(least, (values * self.salts[::-1, None]).min(axis=1), out=least)
        least = least.reshape(self.shape)
        key = np.zeros(self.shape[:2], np.uint64)
        for i in range(self.shape[2]):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, :, i])
        return key


def signatures(docs: DataFrame, id_column: str, text: str, words: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, h, a, b): size and 128-bit digest of the set, keys of both collections.

    ``h`` is null and the keys are empty for an empty set.
    """
    def make():
        shingles, signer = Shingles(words), Signer()

        def run(columns):
            out = []
            for t in columns[1]:
                found = shingles.of(t)
                if not len(found):
                    out.append((0, None, [], []))
                    continue
                keys = signer.of(found).astype(np.int64)
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                out.append((len(found), digest, keys[0].tolist(), keys[1].tolist()))
            return out
        return run

    return map_texts(docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")), ["id", "t"],
                     "n_shingles long, h binary, a array<long>, b array<long>", make)


def shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs at least twice. Counts are partial before the shuffle, and the
    join back is one row per key against the rows, so a hot key's rows can be split."""
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key)
    return rows.join(again, key)


def members(classes: DataFrame) -> DataFrame:
    """(key, h, n) of every table entry that at least two sets share.

    A set can share a table only if it shares a sub-key of each collection, so the sub-keys are
    matched first and only those shared are paired.
    """
    def marked(s):
        return lambda x, i: F.struct(F.lit(s).alias("s"), i.alias("i"), x.alias("x"))

    subs = classes.select("h", F.explode(F.concat(*[
        F.transform(c, marked(s)) for s, c in enumerate("ab")])).alias("k"))
    subs = subs.select("h", F.col("k.s").alias("s"), "k.i", F.col("k.x").alias("x"),
                       F.xxhash64("k.s", "k.i", "k.x").alias("sub"))
    lists = shared(subs, "sub").groupBy("h").agg(       # at most 2 * SUB entries a set
        *[F.array_sort(F.collect_list(F.when(F.col("s") == s, F.struct("i", "x")))).alias(c)
          for s, c in enumerate("ab")])
    pairs = (lists.withColumn("a", F.explode("a")).withColumn("b", F.explode("b"))
             .select("h", F.xxhash64("a.i", "b.i", "a.x", "b.x").alias("key")))
    return shared(pairs, "key")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of the edges is connected with.

    Each round gives every node the smallest of itself and its neighbours and replaces the edges by
    those between different such roots, so that the edges shrink fast. The rounds' answers are
    chained at the end. Every round is written to the shared folder, and nothing is gathered in one
    place.
    """
    def tidy(pairs):
        return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where(
            "x <> y").distinct()

    level = stored(tidy(edges.select(F.col(a).alias("x"), F.col(b).alias("y"))))
    rounds = []
    while not rounds or level.limit(1).count():
        both = level.unionByName(level.select(F.col("y").alias("x"), F.col("x").alias("y")))
        found = stored(both.groupBy("x").agg(F.min("y").alias("y"))
                       .select(F.col("x").alias("node"), F.least("x", "y").alias("root")))
        rounds.append(found)
        left = found.select(F.col("node").alias("x"), F.col("root").alias("rx"))
        right = found.select(F.col("node").alias("y"), F.col("root").alias("ry"))
        level = stored(tidy(level.join(left, "x").join(right, "y")
                            .select(F.col("rx").alias("x"), F.col("ry").alias("y"))))
    out = rounds[0]
    for found in rounds[1:]:
        step = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = out.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return stored(out)


class Forest:
    """Union-find over numbers from 0."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, x: int, others: np.ndarray) -> list[int]:
        """Connect x with the others; returns one of them from each component that was not x's."""
        new = []
        for y in others.tolist():
            if self.root[y] != self.root[x]:
                new.append(y)
                self.root[self.root == self.root[y]] = self.root[x]
        return new


def linked(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the sets that connect what the full sets connect, at most one per set.

    ``side`` is 0 or 1; sets of two sides are compared across only, those of one side among
    themselves. All intersections of a set are counted at once over an inverted index.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    _, token = np.unique(tokens, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    by = np.argsort(token, kind="stable")
    posting, start = owner[by], np.concatenate(([0], np.cumsum(np.bincount(token))))
    ends = np.cumsum(sizes)
    two, forest, out = side.any() and not side.all(), Forest(n), []
    for x in range(n):
        if two and side[x]:
            continue
        other = (side == 1) if two else (np.arange(n) > x)
        if not (other & (forest.root != forest.root[x])).any():
            continue
        mine = token[ends[x] - sizes[x]:ends[x]]
        counts = np.bincount(np.concatenate([posting[start[t]:start[t + 1]] for t in mine.tolist()]),
                             minlength=n)
        near = np.flatnonzero(other & (100 * counts >= percent * (sizes[x] + sizes - counts)))
        out += [(x, y) for y in forest.join(x, near)]
    return out


def confirmed(sets: DataFrame, clusters: DataFrame, percent: int, room: int = ROOM) -> DataFrame:
    """(a, b): links confirmed on full sets (h, n, s), enough to connect what all links connect.

    Sets of one cluster of candidates are compared in a task. A cluster with more than ``room``
    shingles is cut into blocks and every two blocks meet in a task of their own, so that no task
    holds more than two blocks; small clusters share tasks.
    """
    rows = sets.join(clusters.withColumnRenamed("node", "h"), "h")
    sizes = rows.groupBy("root").agg(F.sum("n").alias("total"))
    sizes = stored(sizes.withColumn("blocks", F.ceil(F.col("total") / room)))
    many = F.col("blocks") > 1
    total = sizes.where(~many).agg(F.sum("total")).first()[0] or 0
    shelves = max(1, -(-int(total) // room))
    own = F.pmod(F.xxhash64("h"), F.col("blocks"))
    # Block i meets blocks j >= i: a set goes to all tasks of its block, as side 0 or 1.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = (rows.join(sizes.drop("total"), "root").withColumn("own", own).withColumn("other", other)
              .select("root", "h", "s", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                      (F.col("own") > F.col("other")).cast("int").alias("side"),
                      F.when(many, F.xxhash64("root")).otherwise(
                          F.pmod(F.xxhash64("root"), F.lit(shelves))).alias("shelf")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby("root", sort=False):
            if len(part) > 1:
                names = part["h"].tolist()
                found = linked([np.frombuffer(s, "<u8") for s in part["s"]], part["side"].to_numpy(), percent)
                out += [(names[x], names[y]) for x, y in found]
        return pd.DataFrame(out, columns=["a", "b"])

    return placed.groupBy("shelf", "i", "j").applyInPandas(run, "a binary, b binary")


def links(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) over all sets that confirmed links connect.

    The tables connect candidates to clusters; no link leaves its cluster, as its two sets share a
    table. Within each cluster all sets are compared.
    """
    heads = entries.groupBy("key").agg(F.min("h").alias("a"))
    stars = entries.join(heads, "key").where("h <> a").select("a", F.col("h").alias("b")).distinct()
    return components(stored(confirmed(sets, components(stars), percent)))


def groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = SHINGLE,
           percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept): near-duplicate components of whole texts.

    A text's set holds its distinct shingles of ``words`` words ``[^\\x20\\x09-\\x0D]+`` with A-Z
    lower-cased; with fewer words the whole sequence is its one shingle. Texts whose sets have
    100 * intersection >= ``percent`` * union are linked; ``component_id`` is the smallest id
    reachable and ``kept`` marks the row that has it. Null texts and texts without words are linked
    with nothing. Equal sets are one class, so copies cost nothing further. A null id takes no part:
    its component is null and it is not kept. Repeated ids are rows of their own. Other columns are
    ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("t"))
    signed = stored(signatures(rows, "id", "t", words))
    usable = signed.where("h IS NOT NULL AND id IS NOT NULL")
    classes = usable.groupBy("h").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"),
                                      F.first("a").alias("a"), F.first("b").alias("b"))
    classes = stored(classes)
    entries = stored(members(classes))
    wanted = stored(entries.select("h").distinct().join(classes.select("h", "rep"), "h"))
    # Full sets of the candidates only. Repeated ids may bring other texts; the digest sorts them out.
    found = (rows.where("id IS NOT NULL")
             .join(wanted.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))

    def make():
        shingles = Shingles(words)

        def run(columns):
            out = []
            for t in columns[1]:
                s = shingles.of(t)
                out.append((hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None,
                            s.astype("<u8").tobytes()))
            return out
        return run

    sets = map_texts(found, ["id", "t"], "h binary, s binary", make)
    sets = stored(sets.join(wanted.select("h", "rep"), "h").where("id = rep")
                  .groupBy("h").agg(F.first("s").alias("s"))
                  .withColumn("n", F.length("s") / 8))
    roots = links(entries, sets, percent)
    placed = classes.select("h", "rep").join(roots.withColumnRenamed("node", "h"), "h", "left")
    placed = placed.withColumn("root", F.coalesce("root", "h"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    home = placed.join(least, "root").select("h", "component_id")
    return (signed.select("id", "n_shingles", "h").join(home, "h", "left")
            .select(F.col("id").alias(id_column), "n_shingles",
                    F.when(F.col("id").isNull(), F.lit(None)).otherwise(
                        F.coalesce("component_id", "id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(False))))
