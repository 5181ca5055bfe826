"""Words of many texts at once, as numpy arrays inside tasks.

A word is a run of ASCII digits, ASCII letters and all non-ASCII characters; A-Z count as a-z unless `fold` is off. Its
hash is a polynomial over its bytes, taken from running sums, so a whole buffer is hashed without a loop over words.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
SLICE = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SHINGLE = 5
Batches = Iterator[pa.RecordBatch]
Mapper = Callable[[Batches], Batches]
_shipped: set[str] = set()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = np.arange(256, dtype=np.uint64)
    folded = np.where((code >= 65) & (code <= 90), code + 32, code)
    inside = ((code >= 48) & (code <= 57)) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122)) | (code >= 128)
    return inside, mix(folded * BASE + np.uint64(1)), mix(code * BASE + np.uint64(1))


INSIDE, FOLDED, EXACT = _tables()


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; one pair of tables per process, as long as the longest chunk."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, CHUNK)
        _powers[0] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (BASE, BASE_INVERSE))
    return _powers[0]


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair; the pairs are in order and do not overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + CHUNK, "right")))
        part = values[base:end[j - 1]]
        power, inverse = _power(len(part) + 1)
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(part * power[:len(part)], out=total[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (total[e] - total[s]) * inverse[s]
        i = j
    return mix(out + (end - start).astype(np.uint64))


class Words:
    """The words of some texts: byte offsets in `data`, text number and hash of each; text t has words first[t]:first[t + 1]."""

    def __init__(self, texts: list[bytes], fold: bool = True, marks: bool = False):
        self.buffer = b" ".join(texts) + b" "
        self.data = np.frombuffer(self.buffer, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        inside = INSIDE[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]
        if marks:  # every other visible character is a token of its own
            single = np.flatnonzero(~inside & (self.data > 32))
            start, end = np.concatenate([start, single]), np.concatenate([end, single + 1])
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
        self.start, self.end = start, end
        self.hash = run_hashes((FOLDED if fold else EXACT)[self.data], start, end)
        self.first = np.searchsorted(start, np.concatenate([self.offset, [len(self.data)]]))
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)

    def word(self, i: int) -> bytes:
        return self.buffer[self.start[i]:self.end[i]].lower()


def shingle_sets(words: Words, width: int = SHINGLE) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes. Fewer words than `width`, but not none: one shingle of all."""
    n = len(words.hash)
    combined = np.zeros(n, np.uint64)
    for k in range(width):
        shifted = np.zeros(n, np.uint64)
        shifted[:n - k] = words.hash[k:]
        combined = combined * BASE + shifted
    combined = mix(combined)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(combined[a:b - width + 1]))
        elif b > a:
            out.append(run_hashes(words.hash, np.array([a]), np.array([b])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sliced(sizes: list[int], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most `limit` bytes together; a longer text is alone."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches into slices of bounded text size; null counts as empty."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]
        for a, b in sliced([len(t) for t in texts]):
            yield batch.slice(a, b - a), texts[a:b]


def one_row_each(docs: DataFrame, chosen: DataFrame, repeated: DataFrame, key: str) -> DataFrame:
    """One row of a table from `with_row_key` for each doc_id and key in `chosen`; `repeated` has those that several rows share.

    Rows that are alone under their key are taken as they are; only repeated ones are brought together, after they have been
    reduced to one per task.
    """
    same = lambda a, b: (a[key] == b[key]) & a["doc_id"].eqNullSafe(b["doc_id"])
    chosen, repeated = (t.select("doc_id", key) for t in (chosen, repeated))
    once = chosen.join(repeated, same(chosen, repeated), "left_anti")
    again = chosen.join(repeated, same(chosen, repeated), "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", key)]
    several = docs.join(again.select(F.col("doc_id").alias("_chosen_id"), F.col(key).alias("_chosen_key")), (F.col(key) == F.col("_chosen_key")) & F.col("doc_id").eqNullSafe(F.col("_chosen_id")), "left_semi")
    single = several.groupBy("doc_id", key).agg(F.first(F.struct(*others)).alias("_row")).select("doc_id", *[F.col("_row")[c].alias(c) for c in others])
    return rows_with(docs, once, key).unionByName(single)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from one array per row."""
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with underscores in front if the table has such a column (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """A column that is equal for rows with equal doc_id and text (a hash of both), and its name."""
    key = fresh(docs, "row_key")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


def rows_with(docs: DataFrame, chosen: DataFrame, key: str, kind: str = "left_semi") -> DataFrame:
    """Rows of a table from `with_row_key` whose doc_id and key are in `chosen` (or are not, for left_anti), without the key.

    The texts stay in the JVM: tasks decide on narrow rows, and this join applies the decision.
    """
    few = chosen.select(F.col("doc_id").alias("_chosen_id"), F.col(key).alias("_chosen_key")).distinct()
    return docs.join(few, (F.col(key) == F.col("_chosen_key")) & F.col("doc_id").eqNullSafe(F.col("_chosen_id")), kind).drop(key)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.join(tempfile.mkdtemp(), os.path.basename(package))
        context.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(context.applicationId)


def mapped(df: DataFrame, run: Mapper, kind) -> DataFrame:
    """`mapInArrow` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, kind)
