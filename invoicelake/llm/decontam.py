"""Benchmark decontamination with suffix arrays of the training text.

The training text is cut into shards of bounded size inside the tasks. Each shard gets a suffix array over words, holding
the suffixes that begin like some test suffix (no other suffix can match). Every suffix of every test item is then searched
in it by binary search, word by word: after k words the suffixes that share k words with the test suffix are one interval of
the array. That gives the longest verbatim match of each test suffix and all its places. A place counts when the match is
at least a window long: 10 words, or the whole item if it has fewer.

Words are compared by 64-bit hashes first; the words of every match are then compared letter by letter, and a word
that only shares a hash is taken out of the shard, which is searched again.

Test items are read in blocks of at most `block_bytes`; each block is one pass over the documents, and a row carries what
earlier passes found, so nothing about documents is ever collected. Only a block goes through the driver.

Cases: null and empty texts have no words and no match; items without words are ignored; null item ids are the text
"null"; items with equal ids count as one item; documents are judged row by row, so repeated rows get the same result.
Columns of `docs` other than `text` and `doc_id` are never looked at and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoicelake.llm.words import Mapper, Words, mapped, mix, rows_with, text_slices, with_row_key
from invoicelake.session import staged

WINDOW = 10
BLOCK_BYTES = 8 << 20
FILTER_BITS = 22


class TestBlock:
    """The items of one block as word sequences, ready to be searched for."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        words = Words([text for _, text in items])
        self.hash, self.names = words.hash, [name for name, _ in items]
        self.spelling: dict[int, bytes] = {}
        for i, h in enumerate(words.hash.tolist()):
            if self.spelling.setdefault(h, words.word(i)) != words.word(i):
                raise ValueError("two test words share a hash")
        sizes = words.count
        self.item = words.text
        self.left = np.repeat(words.first[1:], sizes) - np.arange(len(self.hash))
        self.need = np.minimum(window, np.repeat(sizes, sizes))
        self.suffix = np.flatnonzero(self.left >= self.need)
        self.lead = 2 if len(self.suffix) and self.need[self.suffix].min() >= 2 else 1
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        if len(self.suffix):
            self.filter[self._slot(self.hash, self.suffix)] = True

    def _slot(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = hashes[at]
        if self.lead == 2:
            key = mix(key * np.uint64(3) + hashes[at + 1])
        return key >> np.uint64(64 - FILTER_BITS)

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Places of a shard whose first words may begin a test suffix."""
        at = np.arange(max(0, len(hashes) - self.lead + 1))
        return at[self.filter[self._slot(hashes, at)]]


class Shard:
    """Suffix array of a shard; `at` are the places of its suffixes, `stop` the ends of the texts they lie in."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray, stop: np.ndarray, depth: int):
        self.hash, order = hashes, np.argsort(hashes[at], kind="stable")
        self.at, self.stop = at[order], stop[order]
        rank = np.cumsum(np.concatenate([[True], hashes[self.at][1:] != hashes[self.at][:-1]])) if len(at) else at
        for k in range(1, depth):  # sort on by the next word where suffixes are still equal
            equal = np.concatenate([[False], rank[1:] == rank[:-1], [False]])
            tied = np.flatnonzero(equal[1:] | equal[:-1])
            value = self.word(tied, k)
            if not value.any():
                break
            order = np.lexsort((value, rank[tied]))
            value, old = value[order], rank[tied]
            self.at[tied], self.stop[tied] = self.at[tied][order], self.stop[tied][order]
            begins = np.ones(len(rank), bool)
            begins[tied[1:]] = (old[1:] != old[:-1]) | (value[1:] != value[:-1])
            rank = np.cumsum(begins)

    def word(self, i: np.ndarray, k: int | np.ndarray) -> np.ndarray:
        """The k-th word of suffixes by their place in the array; 0 behind the end of the text."""
        at = self.at[i] + k
        return np.where(at < self.stop[i], self.hash[np.minimum(at, len(self.hash) - 1)], np.uint64(0))

    def narrow(self, low: np.ndarray, high: np.ndarray, k: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Within intervals of suffixes that share k words: those whose next word is `value`."""
        def bound(right: bool) -> np.ndarray:
            a, b = low.copy(), high.copy()
            while (busy := np.flatnonzero(a < b)).size:
                mid = (a[busy] + b[busy]) // 2
                word = self.word(mid, k)
                up = word <= value[busy] if right else word < value[busy]
                a[busy[up]], b[busy[~up]] = mid[up] + 1, mid[~up]
            return a
        return bound(False), bound(True)


def search(block: TestBlock, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All matches of the block in a shard: place of the first word, words needed, item, and per text the longest match."""
    hashes = words.hash.copy()
    longest = np.zeros(len(words.count), np.int64)
    while True:
        at = block.candidates(hashes)
        if not len(at) or not len(block.suffix):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), longest
        stop = words.first[1:][words.text[at]]
        shard = Shard(hashes, at, stop, int(block.left.max()))
        suffix, low, high = block.suffix, np.zeros(len(block.suffix), np.int64), np.full(len(block.suffix), len(at))
        found, longest[:] = [], 0
        for k in range(int(block.left.max())):
            keep = block.left[suffix] > k
            suffix, low, high = suffix[keep], low[keep], high[keep]
            low, high = shard.narrow(low, high, k, block.hash[suffix + k])
            keep = low < high
            suffix, low, high = suffix[keep], low[keep], high[keep]
            if not len(suffix):
                break
            full = np.flatnonzero(block.need[suffix] <= k + 1)
            if len(full):
                sizes = high[full] - low[full]
                i = np.repeat(low[full], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                np.maximum.at(longest, words.text[shard.at[i]], k + 1)
                exact = np.repeat(block.need[suffix[full]] == k + 1, sizes)
                found.append((shard.at[i][exact], np.full(int(exact.sum()), k + 1), np.repeat(block.item[suffix[full]], sizes)[exact]))
        places, need, item = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (zip(*found) if found else ((), (), ())))
        hit = covered(places, need, len(hashes))
        wrong = [i for i in np.flatnonzero(hit).tolist() if words.word(i) != block.spelling[int(hashes[i])]]
        if not wrong:
            return places, need, item, longest
        hashes[wrong] = 0


def covered(start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in some start:start + size."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + size, -1)
    return np.cumsum(step[:-1]) > 0


def _blocks(bench: DataFrame, window: int, block_bytes: int) -> list:
    """The test items in blocks: every item once, a bounded number of bytes at a time through the driver."""
    spark = bench.sparkSession
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == b) if n > 1 else items
        yield spark.sparkContext.broadcast(TestBlock([(r["name"], r["text"].encode()) for r in part.toLocalIterator()], window))


def _scan(block, state: dict[str, str]) -> Mapper:
    """One pass: extend the state columns of each row by what the block finds in its text."""
    def run(batches):
        for batch, texts in text_slices(batches, state["text"]):
            words = Words(texts)
            places, need, item, longest = search(block.value, words)
            hit = covered(places, need, len(words.hash))
            was = {k: batch.column(batch.schema.get_field_index(state[k])).to_pylist() for k in ("hits", "items", "longest")}
            edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
            where: dict[int, set] = {}
            for t, i in set(zip(words.text[places].tolist(), item.tolist())):
                where.setdefault(t, set()).add(block.value.names[i])
            hits = [set(h or ()) for h in was["hits"]]
            if len(edges):
                for t, i in zip(words.text[hit].tolist(), np.flatnonzero(hit).tolist()):
                    hits[t].add(i - int(words.first[t]))
            out = {"n_words": pa.array(words.count, pa.int64()), "hits": pa.array([sorted(h) for h in hits], pa.list_(pa.int32())),
                   "items": pa.array([sorted({*(was["items"][t] or ()), *where.get(t, ())}) for t in range(len(texts))], pa.list_(pa.string())),
                   "longest": pa.array([max(a or 0, b) for a, b in zip(was["longest"], longest.tolist())], pa.int64())}
            columns = list(batch.columns)
            for k, v in out.items():
                columns[batch.schema.get_field_index(state[k])] = v
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
    return run


def matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, hits (places of the hit words), items (ids found), longest (words)."""
    state = {k: k for k in ("text", "n_words", "hits", "items", "longest")}
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.lit(0).cast("long").alias("n_words"),
                       F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("longest"))
    kind = f"doc_id {dict(rows.dtypes)['doc_id']}, text string, n_words long, hits array<int>, items array<string>, longest long"
    for block in _blocks(bench, window, block_bytes):
        rows = mapped(rows, _scan(block, state), kind)
    return rows.drop("text")


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    found = matches(docs, bench, window, block_bytes)
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "longest")


def without_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` in which no window of a test item occurs, with all their columns.

    Each block of test items is one pass over the texts, written before the next one starts; only the ids and hashes of
    documents with a hit leave the tasks.
    """
    keyed, key = with_row_key(docs)
    rows = keyed.select("doc_id", key, "text")

    def hits(block) -> Mapper:
        def run(batches):
            for batch, texts in text_slices(batches):
                words = Words(texts)
                found = np.unique(words.text[search(block.value, words)[0]])
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(found, pa.int64())) for i in (0, 1)], ["doc_id", key])
        return run

    out = keyed
    for block in _blocks(bench, window, block_bytes):
        found = staged(mapped(rows, hits(block), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {key} long"), "hits")
        block.destroy()
        out = rows_with(out, found, key, "left_anti").withColumn(key, F.xxhash64("doc_id", "text"))
    return out.drop(key)


ORACLE = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(ws)) AS n, array_to_string(ws[i:i + least({WINDOW}, len(ws)) - 1], ' ') AS run
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least({WINDOW}, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
runs AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS run
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM runs JOIN win USING (n, run)),
per AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN per USING (doc_id) LEFT JOIN items USING (doc_id)
"""
