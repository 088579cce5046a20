"""Quality grades by ordinal cumulative-link regression over hashed text.

One set of weights over hashed words and shapes gives each text a single score f; ordered thresholds
t_1 < t_2 < ... turn it into P(grade >= k) = sigmoid(f - t_k). The expected grade and the tail
probability of the wanted grade serve for selection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import Rolling, map_texts, mix, space_words

BITS = 18
SHAPES = 96          # features behind the hashed words
SIZE = (1 << BITS) + SHAPES


def _bin(share: float, bins: int) -> int:
    return min(int(share * bins), bins - 1)


class Features:
    """Sparse features of a text: presence of hashed words, and one-hot shapes."""

    def __init__(self):
        self.rolling = Rolling(seed=10)
        self.alnum = np.zeros(256, bool)
        self.alnum[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct feature numbers."""
        data, starts, ends = space_words(text or "")
        n = len(starts)
        hashes = self.rolling.ranges(self.rolling.prefix(data), starts, ends)
        words = np.unique((mix(hashes) >> np.uint64(64 - BITS)).astype(np.int32))
        if not n:
            return np.array([1 << BITS], np.int32)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        upper = ((raw >= 65) & (raw <= 90)).mean()
        odd = (~self.alnum[data] & (data != 0x20)).mean()
        digits = ((data >= 48) & (data <= 57)).mean()
        ending = (~self.alnum[data[ends - 1]]).mean()
        lines = [x for x in text.split("\n") if x.strip()]
        repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
        bare = ((ends - starts == 1) & ~self.alnum[data[starts]]).mean()
        shape = [1 + min(int(np.log2(n)), 15)]
        for i, share in enumerate((upper * 2, odd * 2, digits * 2, ending, repeated, bare * 2,
                                   len(words) / n)):
            shape.append(17 + 11 * i + _bin(share, 11))
        return np.concatenate((words, np.array(shape, np.int32) + (1 << BITS)))


@dataclass
class Model:
    weights: np.ndarray         # float32, one per feature
    thresholds: np.ndarray      # ordered, one per grade above the lowest
    grades: list[int]

    def tails(self, score: float) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))


def fit(rows: list[np.ndarray], y: np.ndarray, grades: list[int], steps: int = 150,
        keep: int = 4000, ridge: float = 2e-4) -> Model:
    """Cumulative-link fit by full-batch Adagrad.

    ``y`` holds grade numbers from 0. Words that tell the grades apart in no way beyond chance are
    left out: the ``keep`` with the largest z-score between the grades take part, and all shapes.
    """
    k = len(grades)
    if k < 2:
        return Model(np.zeros(SIZE, np.float32), np.zeros(0), grades)
    columns = np.concatenate(rows)
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    by_grade = np.array([np.bincount(columns[y[row_of] == g], minlength=SIZE) for g in range(k)], float)
    size = np.bincount(y, minlength=k).astype(float)
    total = by_grade.sum(0)
    rate = total / len(y)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
    z = np.abs((by_grade - size[:, None] * rate) / (spread * np.sqrt(size[:, None]))).max(0)
    z[total < 3] = 0
    z[1 << BITS:] = np.inf
    chosen = np.zeros(SIZE, bool)
    chosen[np.argsort(-z, kind="stable")[:keep + SHAPES]] = True
    chosen &= z > 3
    use = chosen[columns]
    columns, row_of = columns[use], row_of[use]
    # Every grade weighs the same.
    weight = (len(y) / k / size)[y]
    theta_gap = np.full(k - 1, 1.0)
    theta_gap[0] = -0.5 * (k - 2)
    w = np.zeros(SIZE)
    seen_w, seen_t = np.full(SIZE, 1e-8), np.full(k - 1, 1e-8)

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

    for _ in range(steps):
        f = np.bincount(row_of, w[columns], len(y))
        theta = np.cumsum(np.concatenate((theta_gap[:1], np.exp(theta_gap[1:]))))
        tail = np.column_stack((np.ones(len(y)), sigmoid(f[:, None] - theta), np.zeros(len(y))))
        here = np.arange(len(y))
        up, down = tail[here, y], tail[here, y + 1]
        p = np.maximum(up - down, 1e-9)
        # d log p / df and d log p / d theta
        slope = tail * (1 - tail)
        g = weight * (slope[here, y] - slope[here, y + 1]) / p / len(y)
        grad = -np.bincount(columns, g[row_of], SIZE) + ridge * w / max(len(grades), 1)
        t_grad = np.zeros(k + 1)
        np.add.at(t_grad, y, -weight * slope[here, y] / p / len(y))
        np.add.at(t_grad, y + 1, weight * slope[here, y + 1] / p / len(y))
        t_grad = -t_grad[1:k]
        gap_grad = np.cumsum(t_grad[::-1])[::-1].copy()
        gap_grad[1:] *= np.exp(theta_gap[1:])
        seen_w += grad * grad
        seen_t += gap_grad * gap_grad
        w -= 0.3 * grad / np.sqrt(seen_w)
        theta_gap -= 0.3 * gap_grad / np.sqrt(seen_t)
    theta = np.cumsum(np.concatenate((theta_gap[:1], np.exp(theta_gap[1:]))))
    return Model(w.astype(np.float32), theta, grades)


def train(docs: DataFrame, ratings: DataFrame, id_column: str = "doc_id", text: str = "text",
          grade: str = "grade", sample: int = 3000) -> Model:
    """Fit on about ``sample`` rated documents of each grade, chosen by a hash of the id.

    ``ratings`` has one integer grade per id (of several the lowest counts; nulls are left out).
    The bound fixes what the driver receives: at most ``sample`` feature lists per grade.
    """
    rated = (ratings.select(F.col(id_column).alias("k"), F.col(grade).cast("int").alias("g"))
             .where(F.col("k").isNotNull() & F.col("g").isNotNull())
             .groupBy("k").agg(F.min("g").alias("g")))
    sizes = {r["g"]: r["count"] for r in rated.groupBy("g").count().collect()}
    grades = sorted(sizes)
    if not grades:
        return fit([], np.zeros(0, int), [])
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for g in grades for x in (F.lit(g), F.lit(min(1.0, sample / sizes[g])))])
    taken = rated.where(draw < share[F.col("g")])
    texts = docs.select(F.col(id_column).alias("k"), F.col(text).alias("t"))
    rows = texts.join(F.broadcast(taken), "k").select("k", "g", "t")    # bounded by ``sample``

    def make():
        features = Features()
        return lambda columns: [(features.of(t).astype("<i4").tobytes(),) for t in columns[2]]

    found = sorted(map_texts(rows, ["k", "g", "t"], "f binary", make).collect(), key=lambda r: r["k"])
    grades = sorted({r["g"] for r in found})
    number = {g: i for i, g in enumerate(grades)}
    return fit([np.frombuffer(r["f"], "<i4") for r in found],
               np.array([number[r["g"]] for r in found], int), grades)


def grade(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text",
          least: int | None = None, tail: float = 0.5, carry: list[str] = ()) -> DataFrame:
    """(id, score, expected_grade, tail_probability, selected) of every whole text.

    ``tail_probability`` is P(grade >= ``least``), the highest grade unless given; ``selected`` says
    that it is at least ``tail``. Null and empty texts are graded by their emptiness feature; if no
    or only one grade was rated, every text is selected. Equal texts get equal answers; an empty
    table gives an empty one; columns besides the id, the text and ``carry`` are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.grades))

    def make():
        features, fitted = Features(), Model(*sent.value)
        wanted = len(fitted.grades) - 1 if least is None else sum(g < least for g in fitted.grades)

        def run(columns):
            out = []
            for t in columns[-1]:
                score = float(fitted.weights[features.of(t)].sum(dtype=np.float64))
                tails = fitted.tails(score)
                steps = np.diff(fitted.grades) if len(fitted.grades) else np.zeros(0)
                expected = float((fitted.grades or [0])[0] + (tails * steps).sum())
                p = (1.0 if wanted <= 0 else 0.0 if wanted > len(tails) else float(tails[wanted - 1]))
                out.append((score, expected, p, p >= tail))
            return out
        return run

    return map_texts(docs, [id_column, *carry, text], "score double, expected_grade double, "
                     "tail_probability double, selected boolean", make)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades of ``labels``: 2 for good and not toxic, 1 for one fault, 0 for both."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
