"""Helpers shared by the operators: table access, Arrow batches of bounded size, byte hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import stored  # noqa: F401  for the operators

#: Rows and text bytes that an Arrow function handles at a time.
BATCH_ROWS, BATCH_BYTES = 512, 4_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded rows and text bytes (one row at least)."""
    for batch in batches:
        sizes = np.fromiter((len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(text)),
                            np.int64, batch.num_rows)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > BATCH_BYTES or i - start >= BATCH_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(docs: DataFrame, columns: list[str], fields: str,
              make: Callable[[], Callable[[list], list[tuple]]]) -> DataFrame:
    """Apply a function to batches of rows of ``columns`` (the last one is the text).

    ``make()`` is called once per task and returns the function, which gets a list of columns and
    returns one tuple of the ``fields`` per row. The other columns are returned unchanged.
    """
    kept = columns[:-1]
    rows = docs.select(*columns)
    schema = T.StructType([rows.schema[c] for c in kept]
                          + T.StructType.fromDDL(fields).fields)
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    new = [arrow.field(i) for i in range(len(kept), len(arrow))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        for batch in small_batches(batches, columns[-1]):
            function = function or make()
            found = function([batch.column(c).to_pylist() for c in columns])
            values = list(zip(*found)) if found else [[] for _ in new]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).cast(arrow.field(c).type) for c in kept]
                + [pa.array(v, f.type) for v, f in zip(values, new)], schema=arrow)

    return rows.mapInArrow(run, schema)


def crc_mod_4(doc_id) -> "F.Column":
    """crc32 of the id's text modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


class Rolling:
    """Polynomial hashes of byte ranges modulo 2^64, from prefix sums.

    ``prefix`` gives P with P[i] = sum of t(byte j) * base^j for j < i; the hash of bytes s..e-1 is
    (P[e] - P[s]) * base^-s, the same wherever the bytes stand. Equal bytes have equal hashes;
    different bytes may collide, so users verify.
    """

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
        self.base = int(rng.integers(2**32, 2**63)) | 5
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 1 << 16)
            back = pow(self.base, -1, 2**64)
            for name, factor in (("power", self.base), ("inverse", back)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[:len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.inverse[start]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def space_words(text: str, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as bytes: the words joined by single spaces, and each
    word's start and end in them."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw.translate(LOWER) if lower else raw, np.uint8)
    gap = SPACE[data]
    before = np.empty_like(gap)
    if len(gap):
        before[0], before[1:] = True, gap[:-1]
    data = np.where(gap, np.uint8(0x20), data)[~(gap & before)]
    if len(data) and data[-1] == 0x20:
        data = data[:-1]
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none
    cuts = np.flatnonzero(data == 0x20)
    return data, np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(data)]))
