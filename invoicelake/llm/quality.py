"""Quality classifier by importance resampling.

Two bag-of-n-grams models with hashed features are estimated: one of the target text (documents labelled good) and one of
the raw text (all documents). The log of their ratio, summed over a document's n-grams, is its log importance weight.
Documents are then sampled without replacement by Gumbel top-k: every weight gets standard Gumbel noise that follows from
the document's own hash, and the k largest are taken.

- Tokens keep their case, and every visible mark is a token; features are unigrams and bigrams in `2**bits` counters.
- Raw counts cover all documents. Target documents and the labelled rows that decide k are a bounded sample: the
  `LABELLED` labelled rows of each class with the smallest hash of doc_id. One row in `HELD` is kept out of the target.
- A ratio is (target count + SMOOTHING) / (expected target count + SMOOTHING), so n-grams seen a few times say little.
- k is the number of documents whose weight passes a cut, counted over all documents. The cut comes from the labelled rows
  kept out of the target: the lowest one within `SLACK` of the best sum of both classes' rates. `k` may be given instead.
- The k-th largest key is found exactly by counting digits of the keys, four rounds of at most 65,536 counters.

Cases: null and empty texts have no n-grams, so their weight is 0 before noise; labels with null doc_id or null quality are
ignored; of several labels for one doc_id the smallest counts; without labelled rows of both classes every document is kept;
rows with equal doc_id and text have equal keys, and rows tied at the k-th key are all kept. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoicelake.llm.words import BASE, Mapper, Words, mapped, mix, rows_with, text_slices, with_row_key
from invoicelake.session import staged

BITS = 18
LABELLED = 20_000
SMOOTHING = 8.0
HELD = 4
SLACK = 0.01
DIGITS = (48, 32, 16, 0)


def features(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, counter) of every unigram and every bigram."""
    shift = np.uint64(64 - bits)
    inner = np.flatnonzero(words.text[1:] == words.text[:-1])
    pair = mix(words.hash[inner] * BASE + words.hash[inner + 1])
    return np.concatenate([words.text, words.text[inner]]), (np.concatenate([words.hash, pair]) >> shift).astype(np.int64)


def labelled_sample(labels: DataFrame, column: str, size: int = LABELLED) -> dict[int, int]:
    """doc_id -> 0/1 for at most `size` rows of each class, those with the smallest hash of doc_id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.min(column).alias("y"))
    out: dict[int, int] = {}
    for y in (0, 1):
        picked = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).collect()
        out.update((r["doc_id"], y) for r in picked)
    return out


def _counts(target: np.ndarray, bits: int) -> Mapper:
    """Counters of all texts and of the target texts of one partition."""
    def run(batches):
        raw, good = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch, texts in text_slices(batches):
            text, counter = features(Words(texts, fold=False, marks=True), bits)
            raw += np.bincount(counter, minlength=1 << bits)
            chosen = np.isin(np.array([-1 if i is None else i for i in batch.column(0).to_pylist()], np.int64), target)
            chosen &= np.array([i is not None for i in batch.column(0).to_pylist()], bool)
            good += np.bincount(counter[chosen[text]], minlength=1 << bits)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["counter", "raw", "good"])
    return run


def fit(docs: DataFrame, sample: dict[int, int], bits: int = BITS) -> np.ndarray:
    """Log ratio of the target model to the raw model for each counter."""
    target = np.array(sorted(i for i, y in sample.items() if y == 1 and not held(i)), np.int64)
    sums = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _counts(target, bits), "counter long, raw long, good long")
    rows = sums.groupBy("counter").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[rows["counter"]], good[rows["counter"]] = rows["raw"], rows["good"]
    expected = raw * (good.sum() / max(1.0, raw.sum()))
    return np.log((good + SMOOTHING) / (expected + SMOOTHING))


def held(doc_id: int) -> bool:
    """Whether a labelled row is kept out of the target, to decide k."""
    return int(mix(np.array([doc_id], np.int64).view(np.uint64))[0]) % HELD == 0


def _weigh(model, bits: int) -> Mapper:
    def run(batches):
        for batch, texts in text_slices(batches):
            words = Words(texts, fold=False, marks=True)
            text, counter = features(words, bits)
            weight = np.bincount(text, weights=model.value[counter], minlength=len(texts)) if len(text) else np.zeros(len(texts))
            seed = np.array([0 if i is None else i for i in batch.column(0).to_pylist()], np.int64).view(np.uint64)
            sums = np.zeros(len(texts), np.uint64)
            np.add.at(sums, words.text, mix(words.hash + np.arange(len(words.hash), dtype=np.uint64) - words.first[words.text].astype(np.uint64)))
            uniform = ((mix(mix(seed + np.uint64(1)) + sums) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
            key = weight - np.log(-np.log(uniform))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight), pa.array(key), pa.array(_ordered(key))], [*batch.schema.names, "w", "k", "o"])
    return run


def _ordered(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def cut_of(weights: np.ndarray, good: np.ndarray) -> float:
    """The lowest weight that separates nearly best by the sum of the two classes' rates of right answers; the middle of its gap."""
    order = np.argsort(weights, kind="stable")
    w, y = weights[order], good[order]
    right = np.concatenate([[0], np.cumsum(~y)]) / max(1, (~y).sum()) + (y.sum() - np.concatenate([[0], np.cumsum(y)])) / max(1, y.sum())
    edges = np.concatenate([[True], w[1:] > w[:-1], [True]])
    best = int(np.flatnonzero(edges)[np.argmax(right[edges] >= right[edges].max() - SLACK)])
    if best in (0, len(w)):
        return float(w[0] - 1) if best == 0 else float(w[-1] + 1)
    return float((w[best - 1] + w[best]) / 2)


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, exactly. None if there are fewer values."""
    prefix, rest = 0, k
    rows = keys.select(F.col(column).bitwiseXOR(F.lit(-(1 << 63))).alias("v"))  # unsigned order
    for shift in DIGITS:
        digit = F.shiftrightunsigned("v", shift)
        part = rows.where(F.shiftrightunsigned("v", shift + 16) == prefix) if shift < 48 else rows
        counts = dict(part.groupBy(digit.alias("d")).count().toLocalIterator())
        for d in sorted(counts, reverse=True):
            if rest <= counts[d]:
                prefix = d
                break
            rest -= counts[d]
        else:
            return None
        prefix &= (1 << (64 - shift)) - 1
    return (prefix ^ (1 << 63)) - (1 << 64) if prefix ^ (1 << 63) >= 1 << 63 else prefix ^ (1 << 63)


def weighed(docs: DataFrame, labels: DataFrame, bits: int = BITS, size: int = LABELLED, extra: list[str] | None = None) -> tuple:
    """doc_id, `extra` columns, w (log weight), k (with noise) and o (k as an ordered integer); the labelled sample; the model."""
    spark = docs.sparkSession
    sample = labelled_sample(labels, "quality", size)
    rows = docs.select("doc_id", "text", *(extra or []))
    if len(set(sample.values())) < 2:
        model = np.zeros(1 << bits)
    else:
        model = fit(docs, sample, bits)
    kind = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    shared = spark.sparkContext.broadcast(model)
    scored = mapped(rows, _weigh(shared, bits), f"{kind}, w double, k double, o long")
    return staged(scored.drop("text"), "weights"), sample, shared


def threshold(scored: DataFrame, sample: dict[int, int], k: int | None = None) -> int | None:
    """The smallest ordered key that is sampled; None: all rows are."""
    if k is None:
        if len(set(sample.values())) < 2:
            return None
        spark = scored.sparkSession
        rows = [(i, y) for i, y in sample.items() if held(i)]
        known = F.broadcast(spark.createDataFrame(rows, "doc_id long, y int"))  # at most 2 * LABELLED rows
        got = scored.join(known, "doc_id").groupBy("doc_id").agg(F.min("w").alias("w"), F.min("y").alias("y")).toPandas()
        if got["y"].nunique() < 2:
            return None
        k = scored.where(F.col("w") >= cut_of(got["w"].to_numpy(), got["y"].to_numpy() == 1)).count()
    return kth_largest(scored, "o", k) if k > 0 else 1 << 63


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, bits: int = BITS) -> DataFrame:
    """One row per row of `docs`: doc_id, log_weight, sample_key, kept."""
    scored, sample, _ = weighed(docs, labels, bits)
    low = threshold(scored, sample, k)
    kept = F.lit(True) if low is None else F.lit(False) if low >= 1 << 63 else F.col("o") >= low
    return scored.select("doc_id", F.col("w").alias("log_weight"), F.col("k").alias("sample_key"), kept.alias("kept"))


def sampled(docs: DataFrame, labels: DataFrame, k: int | None = None, bits: int = BITS) -> DataFrame:
    """The rows of `docs` that are sampled, with all their columns: decided on written weights, applied by a join on doc_id and text hash."""
    keyed, key = with_row_key(docs)
    scored, sample, _ = weighed(keyed, labels, bits, extra=[key])
    low = threshold(scored, sample, k)
    if low is None:
        return docs
    if low >= 1 << 63:
        return docs.limit(0)
    return rows_with(keyed, scored.where(F.col("o") >= low), key)
