"""Language identification by words first, then by ever shorter character n-grams.

A known word scores each language by its log frequency there. A word that no language has learned
falls back to its longest known character n-grams, from ``MAX_GRAM`` characters down to one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import crc_mod_4, map_texts, small_batches

WORD = re.compile(r"[^\W\d_]+")
MAX_GRAM = 5
#: Log share below which one word cannot push a language further.
FLOOR = -6.0
#: Words whose scores a task keeps; beyond it the store is emptied.
KEPT = 200_000


def grams(word: str, n: int) -> list[str]:
    marked = f"_{word}_"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          sample: int = 1200, words: int = 40_000, units: int = 20_000) -> dict[str, dict]:
    """Counts of words and n-grams per language, from texts with a non-null language.

    About ``sample`` documents of each language are read, chosen by a hash of the id, so that equal
    input gives an equal model. The ``words`` most frequent words and ``units`` most frequent
    n-grams of each language are kept. These bounds fix the model's size whatever the table's.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull())
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not sizes:
        return {}
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for k, n in sorted(sizes.items())
                           for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    taken = rows.where(draw < share[F.col("l")]).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t"):
            seen: dict[str, Counter] = {}
            for language, value in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                seen.setdefault(language, Counter()).update(WORD.findall(value.lower()))
            out = []
            for language, found in seen.items():
                parts = Counter()
                for word, n in found.items():
                    for size in range(1, MAX_GRAM + 1):
                        for gram in grams(word, size):
                            parts[gram] += n
                out += [(language, 0, w, n) for w, n in found.items()]
                out += [(language, len(g), g, n) for g, n in parts.items()]
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(),
                                                          pa.int64()))], names=["l", "size", "u", "n"])

    counts = (taken.mapInArrow(count, "l string, size int, u string, n long")
              .groupBy("l", "size", "u").agg(F.sum("n").alias("n")))
    kind = F.least("size", F.lit(1))
    rank = F.row_number().over(Window.partitionBy("l", kind).orderBy(F.desc("n"), "size", "u"))
    totals = counts.groupBy("l", "size").agg(F.sum("n").alias("total"))
    best = (counts.withColumn("rank", rank)
            .where(F.col("rank") <= F.when(F.col("size") == 0, words).otherwise(units)))
    model: dict[str, dict] = {k: {"units": {}, "totals": {}} for k in sorted(sizes)}
    for r in totals.collect():
        model[r["l"]]["totals"][r["size"]] = r["total"]
    for r in best.select("l", "size", "u", "n").collect():
        model[r["l"]]["units"][r["size"], r["u"]] = r["n"]
    return model


class Scorer:
    """Log shares of the languages for words, with the back-off."""

    def __init__(self, model: dict[str, dict]):
        self.names = sorted(model)
        self.units: dict[tuple[int, str], list[float]] = {}
        floors = [[math.log(0.5 / (model[k]["totals"].get(size, 0) + 1)) for k in self.names]
                  for size in range(MAX_GRAM + 1)]
        for i, name in enumerate(self.names):
            totals = model[name]["totals"]
            for (size, unit), n in model[name]["units"].items():
                row = self.units.setdefault((size, unit), floors[size].copy())
                row[i] = math.log((n + 0.5) / (totals[size] + 1))
        self.known: dict[str, tuple[float, ...]] = {}

    def word(self, word: str) -> tuple[float, ...]:
        found = self.known.get(word)
        if found is None:
            found = self._score(word)
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[word] = found
        return found

    def _score(self, word: str) -> tuple[float, ...]:
        """Log shares of the languages: of the word, else of its longest known n-grams on average."""
        row = self.units.get((0, word))
        size = min(MAX_GRAM, len(word) + 2)
        while row is None and size:
            rows = [r for g in grams(word, size) if (r := self.units.get((size, g))) is not None]
            if rows:
                row = rows[0] if len(rows) == 1 else [sum(c) / len(rows) for c in zip(*rows)]
            size -= 1
        if row is None:
            return (-math.log(len(self.names)),) * len(self.names)
        top = max(row)
        whole = top + math.log(sum(math.exp(x - top) for x in row))
        return tuple(max(x - whole, FLOOR) for x in row)

    def text(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall((text or "").lower())
        if not any(c.isalpha() for w in words for c in w) or not self.names:
            return "und", 0.0
        counts = Counter(words)
        rows = np.array([self.word(w) for w in counts])
        mean = np.fromiter(counts.values(), float, len(counts)) @ rows / len(words)
        share = np.exp(mean - mean.max())
        best = int(np.argmax(share))       # the first of equals: names are sorted
        return self.names[best], float(1 / share.sum())


def identify(docs: DataFrame, model: dict[str, dict], id_column: str = "doc_id",
             text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text; the prediction sees the text alone.

    ``lang_pred`` is a learned language, ties to the smaller name, or ``und`` with score 0 if the
    text is null or has no letter, or nothing was learned. ``score`` is the best language's share
    of the geometric mean of the words' shares. Equal texts get equal answers; null ids stay null;
    other columns are ignored; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(sent.value)
        return lambda columns: [scorer.text(t) for t in columns[-1]]

    kept = [id_column] + (["held_out"] if "held_out" in docs.columns else [])
    return map_texts(docs, [*kept, text], "lang_pred string, score double", make)


def train_and_identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, then label all; (doc_id, held_out,
    lang_pred, score). A null id is neither held out nor learned from."""
    rest = crc_mod_4("doc_id")
    model = learn(docs.where(rest != 2))
    marked = docs.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text")
    return identify(marked, model)
