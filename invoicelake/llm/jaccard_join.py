"""Similarity join on word shingles: MinHash banding, then verification on the full shingle sets.

1. Every text becomes its set of five-word shingles (64-bit hashes). Texts with equal sets are one class of copies; only
   the class goes on, so a group of thousands of copies costs one row.
2. Bands and rows per band follow from the wanted recall at the threshold (`plan_bands`). Classes that share a band hash
   meet in a shuffle on (band, hash); each bucket only links its members to its smallest one, so a bucket of any size makes
   as many rows as it has members.
3. The components of these links are the sets of classes among which candidate pairs can exist. Each is cut into blocks of
   at most `BLOCK` classes and about `BLOCK_BYTES` of text, and every pair of blocks is one group of bounded size. A pair of classes is a candidate
   if any band agrees; it is then verified on the full sets. Nothing is capped: a large component only makes more groups.
4. A class learns its number of links by summing over the groups. The groups give a spanning forest of the links that
   they verified; the components of these edges are the result's classes.

Cases: null and empty texts, and texts without words, have an empty set, are similar to nothing and stay alone, each row
for itself. Texts of one to four words are one shingle of all their words. Rows that repeat a doc_id are members like any
other; null ids take part and come last in `class_id` (null only if all ids of the class are null). Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoicelake.llm.graph import components
from invoicelake.llm.words import SHINGLE, Mapper, Words, lists, mapped, mix, one_row_each, shingle_sets, text_slices, with_row_key
from invoicelake.session import staged

THRESHOLD = 0.8
RECALL = 0.9995
MAX_HASHES = 128
BLOCK = 256
BLOCK_BYTES = 2 << 20


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding within `max_hashes` that finds a pair at the threshold with `recall`."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-threshold ** rows))) if threshold < 1 else 1
        if bands * rows > max_hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One row per set, one column per band; sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros((len(sets), bands), np.uint64)
    for k in range(bands * rows):
        low = np.minimum.reduceat(flat * seeds[k], starts)
        out[:, k // rows] = mix(out[:, k // rows] * np.uint64(31) + low)
    return out


def _sets(width: int, bands: int, rows: int) -> Mapper:
    def run(batches):
        for batch, texts in text_slices(batches):
            sets = shingle_sets(Words(texts), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            key = [_key(s) for s in sets]
            marks = np.zeros((len(sets), bands), np.uint64)
            if full:
                marks[full] = band_hashes([sets[i] for i in full], bands, rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in ("id", "row")), pa.array(key, pa.binary()),
                 lists(list(marks.view(np.int64)), pa.int64()), pa.array([len(t) for t in texts], pa.int64())], ["id", "row", "key", "bands", "size"])
    return run


def _key(shingles: np.ndarray) -> bytes | None:
    """128 bits that stand for the whole set; none for an empty one."""
    if not len(shingles):
        return None
    a, b = mix(shingles).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def _verify(threshold: float, width: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Counts and links for one group: the pairs within block x, or between blocks x and y."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        pdf = pdf.sort_values("row", kind="stable").reset_index(drop=True)
        left = np.flatnonzero(pdf["block"].to_numpy() == x)
        right = left if x == y else np.flatnonzero(pdf["block"].to_numpy() == y)
        bands = np.stack(pdf["bands"].to_numpy()) if len(pdf) else np.empty((0, 0), np.int64)
        pair = np.zeros((len(left), len(right)), bool)
        for k in range(bands.shape[1]):
            pair |= bands[left, k][:, None] == bands[right, k][None, :]
        if x == y:
            pair = np.triu(pair, 1)
        sets = shingle_sets(Words([(t or "").encode() for t in pdf["text"]]), width)
        if any(_key(s) != bytes(k) for s, k in zip(sets, pdf["key"])):
            raise RuntimeError("the documents changed between two scans")
        size = np.array([len(s) for s in sets], np.int64)
        common = _common([sets[i] for i in left], [sets[i] for i in right], pair)
        union = size[left][:, None] + size[right][None, :] - common
        linked = pair & (common >= threshold * union - 1e-9)
        count = np.zeros(len(pdf), np.int64)
        np.add.at(count, left, linked.sum(axis=1))
        np.add.at(count, right, linked.sum(axis=0))
        row = pdf["row"].to_numpy()
        root = _forest(len(pdf), left, right, linked)
        keep = count > 0
        return pd.DataFrame({"row": row[keep], "links": count[keep], "root": row[root][keep]})
    return run


def _common(a: list[np.ndarray], b: list[np.ndarray], pair: np.ndarray, step: int = 4096) -> np.ndarray:
    """Sizes of the intersections. Shingles are columns of 0/1 matrices, a bounded number of columns at a time."""
    out = np.zeros((len(a), len(b)), np.float32)
    rows_a, rows_b = np.flatnonzero(pair.any(axis=1)), np.flatnonzero(pair.any(axis=0))
    if not len(rows_a):
        return out
    va, vb = (np.concatenate([s[i] for i in r]) for s, r in ((a, rows_a), (b, rows_b)))
    ia, ib = (np.repeat(np.arange(len(r)), [len(s[i]) for i in r]) for s, r in ((a, rows_a), (b, rows_b)))
    shared = np.intersect1d(va, vb)
    for begin in range(0, len(shared), step):
        part = shared[begin:begin + step]
        ones = []
        for v, i, n in ((va, ia, len(rows_a)), (vb, ib, len(rows_b))):
            at = np.minimum(np.searchsorted(part, v), len(part) - 1)
            hit = part[at] == v
            m = np.zeros((n, len(part)), np.float32)
            m[i[hit], at[hit]] = 1
            ones.append(m)
        out[np.ix_(rows_a, rows_b)] += ones[0] @ ones[1].T
    return out


def _forest(n: int, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For each of n members the smallest member it is connected to by the links of this group."""
    root = np.arange(n)
    a, b = np.nonzero(linked)
    a, b = left[a], right[b]
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def similar(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> DataFrame:
    """One row per row of `docs`: row, doc_id, class_row (first row of its class), n_copies, n_links."""
    bands, rows = plan_bands(threshold, recall, max_hashes)
    prepared = docs.select(F.col("doc_id").alias("id"), F.col("row"), F.col("text"))
    sets = staged(mapped(prepared, _sets(width, bands, rows), f"id {dict(prepared.dtypes)['id']}, row long, key binary, bands array<long>, size long"), "sets")
    copies = staged(sets.where("key is not null").groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("n_copies")), "copies")
    member = sets.select("id", "row", "key").join(copies, "key", "left").select(
        "id", "row", F.coalesce("first", "row").alias("first"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
    member = staged(member, "members")
    # every row number is a class of its own here, and only the first row of equal sets has its bands looked at
    firsts = sets.join(copies.select(F.col("first").alias("row")), "row", "left_semi")
    marks = firsts.select("row", F.posexplode("bands").alias("band", "mark"))
    buckets = marks.groupBy("band", "mark").agg(F.min("row").alias("low"), F.count("*").alias("n")).where("n > 1")
    # a row needs one link only; the smallest members of its other buckets are linked once for all rows that meet them
    lows = staged(marks.join(buckets, ["band", "mark"]).groupBy("row").agg(F.array_sort(F.collect_set("low")).alias("lows")), "candidates")
    hubs = lows.select("lows").distinct().select(F.explode("lows").alias("a"), F.col("lows")[0].alias("b"))
    groups = components(lows.select(F.col("row").alias("a"), F.col("lows")[0].alias("b")).union(hubs))
    tiles = _tiles(groups, firsts, docs)
    verified = staged(tiles.groupBy("label", "x", "y").applyInPandas(_verify(threshold, width), "row long, links long, root long"), "verified")
    links = verified.groupBy("row").agg(F.sum("links").alias("n_links"))
    joined = components(verified.select("row", "root"), "row", "root")
    out = member.join(links.withColumnRenamed("row", "first"), "first", "left").join(joined.select(F.col("node").alias("first"), "label"), "first", "left")
    return out.select("row", F.col("id").alias("doc_id"), "first", F.coalesce("label", "first").alias("class_row"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _tiles(groups: DataFrame, firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """Cut each component into blocks of bounded members and text; each member goes to every pair with its block.

    A member's block follows from the hash of its row, and the number of blocks from the size of its component.
    """
    sized = staged(groups.join(firsts.select(F.col("row").alias("node"), "size"), "node"), "sizes")
    totals = sized.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    placed = sized.join(totals, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select(F.col("node").alias("row"), "label", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    # texts are smaller than their sets, so texts travel; doc_id goes along as both scans must read the same columns
    return pairs.join(firsts.select("row", "key", "bands"), "row").join(docs.select("row", "text", "doc_id"), "row")


def classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id (smallest doc_id of its class), class_size, n_copies (rows with its very
    set), n_links (other sets it is similar to)."""
    found = staged(similar(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), threshold, width, recall), "similar")
    named = found.groupBy("class_row").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return found.join(named, "class_row").select("doc_id", "class_id", "class_size", F.col("n_copies").cast("long").alias("n_copies"), F.col("n_links").cast("long").alias("n_links"))


def one_per_class(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each class the one with the smallest doc_id (null ids last)."""
    keyed, key = with_row_key(docs)
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    found = staged(similar(numbered, threshold, width, recall), "similar")
    first = found.groupBy("class_row").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col("row").alias("stays"))).alias("best"))
    first = staged(first.select(F.col("best.id").alias("first_id"), F.col("best.stays").alias("row")), "first")
    keys = staged(numbered.select("doc_id", "row", F.xxhash64("doc_id", "text").alias(key)), "keys")
    chosen = staged(keys.join(first, "row").where(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", key), "chosen")
    if chosen.count() != first.count():
        raise RuntimeError("the input changed between two scans")
    repeated = staged(keys.groupBy("doc_id", key).count().where("count > 1"), "repeated")
    return one_row_each(keyed, chosen, repeated, key).select(*docs.columns)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
j AS (SELECT x, y, c = nx.n AND c = ny.n AS same FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
      WHERE 10 * c >= 8 * (nx.n + ny.n - c)),
rep AS (SELECT w.doc_id, least(w.doc_id, min(y)) AS rep, 1 + count(y) AS n_copies FROM w LEFT JOIN j ON x = w.doc_id AND same GROUP BY 1),
e AS (SELECT DISTINCT a.rep AS x, b.rep AS y FROM j JOIN rep a ON a.doc_id = x JOIN rep b ON b.doc_id = y WHERE NOT same),
reach AS (SELECT rep AS x, rep AS y FROM rep UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
cls AS (SELECT x, min(y) AS class_id FROM reach GROUP BY 1),
links AS (SELECT x, count(*) AS n_links FROM e GROUP BY 1)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, n_copies, coalesce(n_links, 0) AS n_links
FROM rep JOIN cls ON cls.x = rep LEFT JOIN links ON links.x = rep
"""
