"""Removal of byte strings that stand earlier in the corpus, with suffix sorting.

Only suffixes at sampled places are sorted. Of the ``GRAM``-byte strings in every window of LENGTH
bytes, the one with the smallest hash is an *anchor*; equal windows have equal anchors at equal
places, so it is enough to compare anchors of equal strings. A window that holds an anchor lies in
the anchor's *context*, the LENGTH - GRAM bytes before it and LENGTH bytes from it on.

1. Anchors are matched by hash. Where all contexts of a string are equal, all but the first of its
   places are covered wholly and nothing needs sorting.
2. Of several contexts, the first place of each is fetched, and the suffixes to the right of the
   anchors and, reversed, to the left are sorted (see ``suffix_sort``). Common extensions of
   neighbours then tell for each offset which windows are equal and which of them comes first.
3. A string with more contexts than one task should sort (``MOST``) is taken apart instead: its
   windows are grouped by a 128-bit digest across all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Rolling, mix, small_batches, stored
from .suffix_sort import Suffixes

LENGTH, GRAM = 100, 32
BEFORE = LENGTH - GRAM              # bytes of context before an anchor
CHUNK = 1 << 18                     # bytes that are handled at a time
MOST = 20_000                       # contexts that one task sorts together
TAG = 1 << 20                       # room below a place for the row's tag and a mark


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every stretch of ``width`` entries."""
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[:len(x) - (width - done)], x[width - done:]) if width > done else x


class Anchors:
    """Anchors of many texts at a time: short texts are joined, so that arrays are long."""

    def __init__(self):
        self.rolling = Rolling(seed=44)

    def _part(self, data: np.ndarray, ends: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, ...]:
        """Places, string hashes and context hashes of the anchors of all windows that begin in
        start..stop-1 and lie in one text; ``ends`` are the ends of all texts in the bytes."""
        low = max(start - BEFORE, 0)
        data = data[low:stop + 2 * LENGTH]
        prefix = self.rolling.prefix(data)
        begin, size = start - low, min(stop - start + LENGTH - 1, len(data) - (start - low))
        n = size - GRAM + 1
        hashes = (prefix[begin + GRAM:begin + GRAM + n] - prefix[begin:begin + n]) \
            * self.rolling.inverse[begin:begin + n]
        hashes = mix(hashes) | np.uint64(1)
        width = LENGTH - GRAM + 1
        least = _sliding(hashes, width, np.minimum)     # one per window
        inside = ends[(ends > start) & (ends < start + size)] - start
        for end in inside.tolist():                     # windows across two texts have none
            least[max(end - LENGTH + 1, 0):end] = 0
        # A place is an anchor if it is least in some window that holds it.
        wall = np.zeros(width - 1, np.uint64)
        top = _sliding(np.concatenate((wall, least, wall)), width, np.maximum)
        places = np.flatnonzero(top == hashes)
        text = np.searchsorted(ends, places + start, "right")
        first = np.concatenate(([0], ends[:-1]))[text]
        a = np.maximum(places + start - BEFORE, first)
        b = np.minimum(places + start + LENGTH, ends[text])
        left = (places + start - a).astype(np.uint64)
        context = mix(self.rolling.ranges(prefix, a - low, b - low) ^ (left << np.uint64(8)))
        return text, places + start - first, hashes[places], context

    def _joined(self, raws: list[bytes]) -> tuple[np.ndarray, ...]:
        ends = np.cumsum([len(r) for r in raws])
        data = np.frombuffer(b"".join(raws), np.uint8)
        parts = [self._part(data, ends, start, min(start + CHUNK, len(data) - LENGTH + 1))
                 for start in range(0, len(data) - LENGTH + 1, CHUNK)]
        if len(parts) == 1:
            return parts[0]
        # A place may be an anchor of windows on both sides of a cut.
        text, place, gram, context = (np.concatenate(x) for x in zip(*parts))
        _, once = np.unique(place + (text << 44), return_index=True)
        return text[once], place[once], gram[once], context[once]

    def of(self, raws: list[bytes]) -> tuple[np.ndarray, ...]:
        """Text number, place, string hash and context hash of all anchors, and whether the place
        is the first with its string and context in the text."""
        out, group, held = [], [], 0
        for i, raw in enumerate(raws):
            if len(raw) < LENGTH:
                continue
            if group and held + len(raw) > CHUNK:
                out.append((group, self._joined([raws[j] for j in group])))
                group, held = [], 0
            group.append(i)
            held += len(raw)
        if group:
            out.append((group, self._joined([raws[j] for j in group])))
        if not out:
            return (np.zeros(0, np.int64),) * 5
        text = np.concatenate([np.array(g)[x[0]] for g, x in out])
        place, gram, context = (np.concatenate([x[k] for _, x in out]) for k in (1, 2, 3))
        key = mix(gram ^ mix(context) ^ (text.astype(np.uint64) << np.uint64(40)))
        by = np.argsort(key, kind="stable")             # places rise within a text
        first = np.ones(len(by), np.int64)
        first[by[1:][key[by[1:]] == key[by[:-1]]]] = 0
        gram, context = gram.view(np.int64), context.view(np.int64)
        return text, place, gram, context, first


def anchors(rows: DataFrame) -> DataFrame:
    """(id, place, gram, context): place holds the byte offset, below it the row's tag, and in the
    lowest bit whether the string has stood in this text before, with the same context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors()
        for batch in small_batches(batches, "t"):
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tag"))
            text, place, gram, context, first = finder.of(
                [t.encode("utf-8", "surrogatepass") for t in batch.column("t").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (
                    ids[text], place * TAG + tags[text] * 2 + 1 - first, gram, context)],
                names=["id", "place", "gram", "context"])

    return (rows.where("id IS NOT NULL AND t IS NOT NULL")
            .mapInArrow(run, "id long, place long, gram long, context long"))


def tag_of(place: str) -> "F.Column":
    return F.floor(F.pmod(place, F.lit(TAG)) / 2).alias("tag")


def contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, id, place, bytes, before) of the wanted (gram, id, place): the anchor's context and how
    many of its bytes stand before the anchor."""
    lists = (wanted.groupBy("id", tag_of("place"))     # one row per text
             .agg(F.collect_list("gram").alias("grams"), F.collect_list("place").alias("places")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t"):
            out = [[], [], [], [], []]
            for key, text, grams, places in zip(*(batch.column(c).to_pylist()
                                                  for c in ("id", "t", "grams", "places"))):
                raw = text.encode("utf-8", "surrogatepass")
                for gram, place in zip(grams, places):
                    p = place // TAG
                    for to, x in zip(out, (gram, key, place, raw[max(p - BEFORE, 0):p + LENGTH],
                                           min(p, BEFORE))):
                        to.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(),
                                                      pa.int32()))],
                names=["gram", "id", "place", "bytes", "before"])

    return (rows.join(lists, ["id", "tag"]).select("id", "t", "grams", "places")
            .mapInArrow(run, "gram long, id long, place long, bytes binary, before int"))


def later_windows(gram: np.ndarray, rank: np.ndarray, texts: list[bytes],
                  before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts sorted by gram: the least and greatest offset o (bytes before the anchor) whose
    window also stands at a context of smaller rank; the least exceeds the greatest if none does.

    All windows of a context overlap, so what they cover is one stretch.
    """
    n = len(texts)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    group = np.cumsum(np.concatenate(([0], gram[1:] != gram[:-1])).astype(np.int64))
    classes = []
    for side in ("right", "left"):
        if side == "right":
            suffixes, places, ends = Suffixes(data, LENGTH), begins + before, begins + lengths
        else:
            suffixes = Suffixes(np.ascontiguousarray(data[::-1]), BEFORE)
            places, ends = len(data) - begins - before, len(data) - begins
        classes.append(suffixes.ordered(places, ends, group))
    after = lengths - before
    low, high = np.full(n, BEFORE + 1), np.full(n, -1)
    ids = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for offset in range(BEFORE + 1):
        for own, (order, shared), depth in zip(ids, classes, (LENGTH - offset, offset)):
            own[order] = np.cumsum(shared < depth)
        takes_part = np.flatnonzero((before >= offset) & (after >= LENGTH - offset))
        if len(takes_part) < 2:
            continue
        key = ids[0][takes_part] * (n + 1) + ids[1][takes_part]
        by = np.lexsort((rank[takes_part], key))
        again = takes_part[by[1:][key[by[1:]] == key[by[:-1]]]]     # not the first of its windows
        low[again] = np.minimum(low[again], offset)
        high[again] = offset
    return low, high


def sorted_covers(found: DataFrame, buckets: int) -> DataFrame:
    """(id, tag, start, end) that suffix sorting covers; ``found`` as ``contexts`` returns it."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["gram", "id", "place"])      # rows equal in id and text
        rank = np.empty(len(frame), np.int64)
        rank[np.lexsort((frame["place"], frame["id"]))] = np.arange(len(frame))
        frame = frame.assign(rank=rank).sort_values("gram", kind="stable", ignore_index=True)
        low, high = later_windows(frame["gram"].to_numpy(), frame["rank"].to_numpy(),
                                  frame["bytes"].tolist(), frame["before"].to_numpy(np.int64))
        at, hit = frame["place"].to_numpy() // TAG, high >= 0
        return pd.DataFrame({"id": frame["id"], "tag": frame["place"] % TAG // 2, "start": at - high,
                             "end": at - low + LENGTH})[hit]

    return (found.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
            .repartition(buckets, "bucket").groupBy("bucket")
            .applyInPandas(run, "id long, tag long, start long, end long"))


def grouped_covers(found: DataFrame) -> DataFrame:
    """(id, tag, start, end) for strings with very many contexts: every window by its digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256).to_pydict()
                out = [[], [], [], []]
                for key, place, text, before in zip(rows["id"], rows["place"], rows["bytes"], rows["before"]):
                    for offset in range(max(0, LENGTH - len(text) + before), before + 1):
                        window = text[before - offset:before - offset + LENGTH]
                        for to, x in zip(out, (hashlib.blake2b(window, digest_size=16).digest(), key,
                                               place, offset)):
                            to.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int32()))],
                    names=["window", "id", "place", "offset"])

    windows = found.select("id", "place", "bytes", "before").mapInArrow(
        run, "window binary, id long, place long, offset int")
    # Equal windows have their anchor at equal offsets, so places compare like the windows' starts.
    first = windows.groupBy("window", "offset").agg(
        F.min(F.struct("id", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    at, offset = F.floor(F.col("place") / TAG), F.col("offset")
    return (windows.join(first, ["window", "offset"])
            .where(F.struct("id", "place") > F.col("first"))
            .select("id", tag_of("place"), (at - offset).alias("start"),
                    (at - offset + LENGTH).alias("end")))


def covers(rows: DataFrame, most: int = MOST) -> DataFrame:
    """(id, tag, start, end): stretches of (id, tag, t) that stand earlier. They may overlap."""
    every = anchors(rows)
    # Written first, so that the join reads plain shuffles, whose hot partitions Spark can split.
    grams = stored(every.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1"),
        F.min("id").alias("least")).where("n > 1")
        .select("gram", (F.col("c0") == F.col("c1")).alias("single"), "least"))
    later = (F.col("id") > F.col("least")) | (F.col("place") % 2 == 1)
    several = F.when(~F.col("single"), F.col("gram")).alias("gram")
    matched = stored(every.join(grams, "gram").where(~F.col("single") | later)
                     .select("id", "place", several,
                             F.when(~F.col("single"), F.col("context")).alias("context")))
    mixed = matched.where("gram IS NOT NULL")
    kinds = stored(mixed.groupBy("gram", "context").agg(F.min("id").alias("least")))
    placed = stored(mixed.join(kinds, ["gram", "context"]).withColumn("later", later))
    whole = matched.where("gram IS NULL").select("id", "place").unionByName(
        placed.where("later").select("id", "place"))
    at = F.floor(F.col("place") / TAG)
    whole = whole.select("id", tag_of("place"), F.greatest(at - BEFORE, F.lit(0)).alias("start"),
                         (at + LENGTH).alias("end"))
    sizes = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > most).select("gram", F.lit(True).alias("large"))
    wanted = placed.where(~F.col("later")).select("gram", "id", "place")
    found = stored(contexts(rows, wanted).join(large, "gram", "left"))
    buckets = max(1, -(-found.count() // most))
    return (whole.unionByName(sorted_covers(found.where("large IS NULL").drop("large"), buckets))
            .unionByName(grouped_covers(found.where("large"))))


def without(raw: bytes, starts: list[int], ends: list[int]) -> tuple[bytes, int, int]:
    """The bytes outside the stretches, how many were removed, and in how many maximal runs."""
    n, kept, at, runs = len(raw), [], 0, 0
    for start, end in sorted(zip(starts, ends)):
        start, end = max(start, 0), min(end, n)
        if start >= end:
            continue
        if start > at or not runs:
            runs += 1
            kept.append(raw[at:start])
        at = max(at, end)
    kept.append(raw[at:])
    out = b"".join(kept)
    return out, n - len(out), runs


def remove(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
           most: int = MOST) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): every whole text without its repeated bytes.

    A byte goes if it is covered by a 100-byte string that also starts earlier: in a text of smaller
    id, or earlier in the same text. ``kept`` are the remaining bytes. A null text is empty; texts
    under 100 bytes are kept. A text with a null id takes no part and is kept whole. Ids should be
    unique: rows equal in id and text count as one and get equal results; different texts of one id
    are compared by place, but not where all of a string's surroundings are equal. An empty table
    gives an empty one; other columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("id", F.pmod(F.xxhash64("t"), F.lit(TAG // 2)).alias("tag"), "t")
    # The stretches of a text are at most as many as its anchors.
    lists = covers(rows, most).groupBy("id", "tag").agg(
        F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t"):
            out = []
            for key, value, starts, ends in zip(*(batch.column(c).to_pylist()
                                                  for c in ("id", "t", "starts", "ends"))):
                raw = value.encode("utf-8", "surrogatepass")
                kept, removed, runs = without(raw, starts or [], ends or [])
                out.append((key, len(raw), removed, runs, kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), (*[pa.int64()] * 4, pa.binary()))],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return (rows.join(lists, ["id", "tag"], "left").select("id", "t", "starts", "ends")
            .mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
            .withColumnRenamed("id", id_column))


def digests(removed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return removed.select(id_column, "n_bytes", "n_removed", "n_spans",
                          F.sha2("kept", 256).alias("kept_sha256"))
