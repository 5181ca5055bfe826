"""Phrase collocations by SON partitioning.

Phrases of one to four words are counted per language within pieces of text; a phrase is frequent from `SUPPORT` on. The rows
are split into `SHARDS` shards by the hash of doc_id and text, which deals copies of a text over all shards, and the SON rule
does the rest:

1. Every shard is mined completely at proportionally lowered support. A shard that holds n_s of the n words of a language
   needs ceil(SUPPORT * n_s / n) occurrences; a phrase below that in every shard is below SUPPORT altogether. A shard
   is spread over all tasks and mined by length: words, then pairs of locally frequent words, then phrases of three and four
   words all of whose pairs are locally frequent in the same shard.
2. The union of all locally frequent phrases is the candidate set.
3. One more pass counts all candidates over all rows exactly, by their texts.

What is locally frequent is passed on as a Bloom filter of fixed size (2^BITS bits, by 64-bit hash of language, phrase and shard), so
the broadcast does not grow with the data. Its false hits, like equal hashes in mining, only add candidates; the exact count
by text decides. Counts of hashes travel packed, as sorted arrays per range of hashes, of which there are
enough for one per `BUCKET_WORDS` words. In step 3 a task tells phrases apart by 64-bit hash before it takes their texts.

Then every frequent phrase of two to four words is scored: cut after its first k words, l and r are the frequencies of both
parts, and the lowest floor(2000000 a / (l + r)) over all cuts counts, the smallest k among equal ones. Products are
decimals. Phrases inside a longer frequent one with at least 80 % of their frequency go. Of the rest each language gives its first
`TOP`.

Cases: null and empty texts have no words; null lang counts as `und`; rows are counted each, so equal rows and null ids count as
often as they occur; ties are settled by the phrase in byte order; an empty table gives an empty result; other columns are
ignored. Texts are cut at separators into blocks of about `SLICE` bytes, so a long text needs no more memory; a piece
without separators is never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from invoicelake.llm.spans import byte_set, joined, span_hashes, word_borders
from invoicelake.llm.words import BASE, FOLDED, Batches, Mapper, mapped, mix, ship
from invoicelake.session import staged

SUPPORT = 30
SHARDS = 3
WORDS = 4
BITS = 26
HASHES = 3
TOP = 2000
SLICE = 4 << 20
HELD = 2_000_000
HELD_TEXTS = 500_000
GROUPS = 100_000
BUCKET_WORDS = 4_000_000
BUCKET = 32768  # bits of one row of bitmap_construct_agg
SEPARATOR = byte_set(*b".,;:!?", (10, 13))
WORD = ~(SEPARATOR | byte_set(9, 32))
LOWER = bytes(range(256)).lower()  # ASCII letters only


# Words and phrases of a block of texts ------------------------------------------------------------------------------

def cut_long(text: bytes, limit: int) -> Iterator[bytes]:
    """Parts of about `limit` bytes, cut at separators only."""
    separators = [bytes([b]) for b in np.flatnonzero(SEPARATOR)]
    begin = 0
    while len(text) - begin > limit:
        cut = max(text.rfind(s, begin, begin + limit) for s in separators)
        if cut < 0:
            after = [k for s in separators if (k := text.find(s, begin + limit)) >= 0]
            if not after:
                break
            cut = min(after)
        yield text[begin:cut]
        begin = cut + 1
    yield text[begin:]


class Block:
    """The words of some texts and the hashes of their phrases. Word i starts a phrase of k words if whole(k)[i]."""

    def __init__(self, texts: list[bytes], lang: list[int], group: list[int]):
        data, buffer, offset = joined(texts)
        self.buffer = buffer
        self.start, self.end = word_borders(data, WORD)
        self.row = np.searchsorted(offset, self.start, "right") - 1
        self.piece = np.cumsum(SEPARATOR[data], dtype=np.int32)[self.start]
        self.groups, index = np.unique(np.array(group, np.int64).view(np.uint64), return_inverse=True)
        self.group = index.astype(np.uint32 if len(self.groups) > 1 << 16 else np.uint16)[self.row]  # a place in `groups` per word
        self.words = span_hashes(data, FOLDED, self.start, self.end)
        self.keys = [mix(self.words + np.array(lang, np.int64).view(np.uint64)[self.row])]

    def key(self, k: int) -> np.ndarray:
        """Hash of language and phrase of k words at every word."""
        while len(self.keys) < k:
            n, last = max(0, len(self.words) - len(self.keys)), len(self.keys)
            longer = np.zeros_like(self.words)
            longer[:n] = mix(self.keys[-1][:n] * BASE + self.words[last:] + np.uint64(last))
            self.keys.append(longer)
        return self.keys[k - 1]

    def whole(self, k: int) -> np.ndarray:
        n = len(self.piece)
        ok = np.zeros(n, bool)
        ok[:max(0, n - k + 1)] = self.piece[:max(0, n - k + 1)] == self.piece[k - 1:]
        return ok

    def text(self, i: int, k: int) -> bytes:
        return b" ".join([self.buffer[self.start[j]:self.end[j]] for j in range(i, i + k)]).translate(LOWER)


def blocks(batches: Batches, limit: int) -> Iterator[tuple[pa.RecordBatch, list[int], Block]]:
    """Blocks of about `limit` bytes of text; columns lang, l (its hash), g (hash of lang and shard), text. With the row of each part."""
    for batch in batches:
        texts, l, g = batch.column(3).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        parts: list[bytes] = []
        rows: list[int] = []
        size = 0
        for i in range(batch.num_rows):
            for part in cut_long(texts[i].as_py() or b"", limit):
                if parts and size + len(part) > limit:
                    yield batch, rows, Block(parts, [l[r] for r in rows], [g[r] for r in rows])
                    parts, rows, size = [], [], 0
                parts.append(part)
                rows.append(i)
                size += len(part)
        if parts:
            yield batch, rows, Block(parts, [l[r] for r in rows], [g[r] for r in rows])


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _signed(values: list[int]) -> list[int]:
    return np.array(values, np.uint64).view(np.int64).tolist()


# Counts of hashes ---------------------------------------------------------------------------------------------------

def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different key, in order, with the sum of its counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


class Tally:
    """Counts of hashes per group, gathered over the blocks of a task and given out as packed rows.

    A packed row holds the hashes in one of `buckets` equal ranges: group by group (`gs`, with `sizes` hashes each), sorted. So
    the shuffle moves one row per task and range, not one per phrase. The first row also has the sum of each group's counts.
    After `HELD` different hashes the counts go out and the tally starts anew.
    """

    def __init__(self, buckets: int):
        self.bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.lang: dict[int, str] = {}
        self.size = 0

    def add(self, block: Block, key: np.ndarray, at: np.ndarray) -> None:
        group = block.group[at]
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(len(block.groups) + 1, dtype=np.int64))
        for g, a, b in zip(block.groups.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
            if b > a:
                own = np.sort(key[at[order[a:b]]])
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                self.parts.setdefault(g, []).append((own[first], np.diff(first, append=len(own)).astype(np.uint32)))
                self.size += len(first)

    def rows(self) -> Batches:
        merged = {g: summed(*map(np.concatenate, zip(*parts))) if len(parts) > 1 else parts[0] for g, parts in self.parts.items()}
        edges = {g: np.concatenate([[0], np.searchsorted(keys, self.bounds), [len(keys)]]).tolist() for g, (keys, _) in merged.items()}
        totals = [(self.lang[g], int(n.sum())) for g, (_, n) in merged.items()]
        for bucket in range(len(self.bounds) + 1):
            own = [(g, edges[g][bucket], edges[g][bucket + 1]) for g in merged if edges[g][bucket] < edges[g][bucket + 1]]
            if own:
                row = {"bucket": bucket, "gs": _signed([g for g, _, _ in own]), "sizes": [b - a for _, a, b in own],
                       "keys": b"".join(merged[g][0][a:b].tobytes() for g, a, b in own), "counts": b"".join(merged[g][1][a:b].astype(np.uint32).tobytes() for g, a, b in own),
                       "totals": [{"lang": lang, "g": g, "n": n} for g, (lang, n) in zip(_signed(list(merged)), totals)]}
                totals = []
                yield pa.RecordBatch.from_pylist([row], PACKED_ARROW)
        self.parts, self.size = {}, 0


PACKED = "bucket int, gs array<long>, sizes array<long>, keys binary, counts binary, totals array<struct<lang: string, g: long, n: long>>"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("gs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("keys", pa.binary()), ("counts", pa.binary()),
                          ("totals", pa.list_(pa.struct([("lang", pa.string()), ("g", pa.int64()), ("n", pa.int64())])))])


def locally_frequent(packed: DataFrame, least: DataFrame) -> DataFrame:
    """(key, g) of the hashes that reach their group's support in all packed rows together.

    The supports of up to `GROUPS` groups go along with the function; with more of them the counts are joined to their supports.
    """
    known = {r["g"]: r["least"] for r in least.limit(GROUPS + 1).collect()}
    few = len(known) <= GROUPS
    known = known if few else {}

    def merge(rows: pa.Table) -> pa.Table:
        keys, counts = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("counts", np.uint32)))
        gs, sizes = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("gs", "sizes"))
        groups, at = np.unique(gs, return_inverse=True)
        group = np.repeat(at, sizes)
        found = []
        for j, g in enumerate(groups.tolist()):
            need = known.get(g) if few else 1
            if need is not None:
                own = group == j
                k, n = summed(keys[own], counts[own])
                found.append((k[n >= need], n[n >= need], g))
        empty = [np.zeros(0, np.uint64)]
        return pa.table({"key": _long(np.concatenate([k for k, _, _ in found] or empty)), "g": pa.array(np.concatenate([np.full(len(k), g) for k, _, g in found] or empty).astype(np.int64)),
                         "n": pa.array(np.concatenate([n for _, n, _ in found] or empty).astype(np.int64))})

    ship(packed.sparkSession)
    merged = packed.select("bucket", "gs", "sizes", "keys", "counts").groupBy("bucket").applyInArrow(merge, "key long, g long, n long")
    return (merged if few else merged.join(least, "g").where("n >= least")).select("key", "g")


# Bit sets -----------------------------------------------------------------------------------------------------------

NO_SALT = np.zeros(1, np.uint64)


def places(key: np.ndarray, salt: np.ndarray, bits: int) -> list[np.ndarray]:
    """The HASHES bits of every hash."""
    h = mix(key ^ mix(salt + np.uint64(1)))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [(h + np.uint64(i) * step) & np.uint64((1 << bits) - 1) for i in range(HASHES)]


class BitSet:
    """A set of hashes as 2^bits bits (a Bloom filter), which may also hold others."""

    def __init__(self, bits: int, rows: Iterator):
        self.bits = bits
        self.bytes = np.zeros(1 << bits >> 3, np.uint8)
        for r in rows:
            part = np.frombuffer(bytes(r["bitmap"]), np.uint8)
            low = r["bucket"] * (BUCKET >> 3)
            self.bytes[low:low + len(part)] = part[:len(self.bytes) - low]

    def holds(self, key: np.ndarray, salt: np.ndarray = NO_SALT) -> np.ndarray:
        found = np.ones(len(key), bool)
        for place in places(key, salt, self.bits):
            found &= (self.bytes[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 != 0
        return found


def bit_set(keys: DataFrame, bits: int, salted: bool) -> BitSet:
    """The set of (key, g), or of the keys alone. At most 2^bits / 32768 rows of 4 kB reach the driver."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            key, g = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            place = np.unique(np.concatenate(places(key, g if salted else NO_SALT, bits)))
            yield pa.RecordBatch.from_arrays([_long(place // np.uint64(BUCKET)), _long(place % np.uint64(BUCKET))], ["bucket", "bit"])

    found = mapped(keys.select("key", "g"), run, "bucket long, bit long").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    return BitSet(bits, found.toLocalIterator())


# Mining -------------------------------------------------------------------------------------------------------------

Starts = Callable[[Block], Iterator[tuple[int, np.ndarray]]]


def _packed(limit: int, buckets: int, starts: Starts) -> Mapper:
    """Counts of the phrases that `starts` gives as (words, places), as packed rows."""
    def run(batches: Batches) -> Batches:
        tally = Tally(buckets)
        for batch, rows, b in blocks(batches, limit):
            names = batch.column(0).take(pa.array(rows, pa.int64())).to_pylist()
            first = np.unique(b.group, return_index=True)
            tally.lang |= {int(b.groups[j]): names[b.row[i]] for j, i in zip(*first)}
            for k, at in starts(b):
                tally.add(b, b.key(k), at)
            if tally.size >= HELD:
                yield from tally.rows()
        yield from tally.rows()
    return run


def _words(b: Block) -> Iterator[tuple[int, np.ndarray]]:
    yield 1, np.arange(len(b.words))


def _pairs(words) -> Starts:
    def starts(b: Block):
        known = np.append(words.value.holds(b.key(1), b.groups[b.group]), False)
        yield 2, np.flatnonzero(b.whole(2) & known[:-1] & known[1:])
    return starts


def _longer(pairs) -> Starts:
    def starts(b: Block):
        known = np.concatenate([b.whole(2) & pairs.value.holds(b.key(2), b.groups[b.group]), np.zeros(2, bool)])
        yield 3, np.flatnonzero(b.whole(3) & known[:-2] & known[1:-1])
        yield 4, np.flatnonzero(b.whole(4) & known[:-2] & known[1:-1] & known[2:])
    return starts


class Texts:
    """Counts of phrases with their texts, gathered over the blocks of a task and given out as one packed row per range of hashes."""

    def __init__(self, buckets: int):
        self.bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # known hashes in order, and where their phrases are
        self.phrases: list[tuple[str, int, bytes]] = []
        self.counts = np.zeros(0, np.int64)

    def add(self, block: Block, k: int, at: np.ndarray, names: list[str]) -> None:
        keys, first, n = np.unique(block.key(k)[at], return_index=True, return_counts=True)
        near = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = near < len(self.keys)
        known[inside] = self.keys[near[inside]] == keys[inside]
        self.counts[self.place[near[known]]] += n[known]
        new = at[first[~known]]
        begin = len(self.phrases)
        self.phrases += [(names[r], k, block.text(i, k)) for i, r in zip(new.tolist(), block.row[new].tolist())]
        self.counts = np.concatenate([self.counts, n[~known]])
        merged = np.concatenate([self.keys, keys[~known]])
        order = np.argsort(merged, kind="stable")
        self.keys, self.place = merged[order], np.concatenate([self.place, np.arange(begin, len(self.phrases))])[order]

    def rows(self) -> Batches:
        edges = np.concatenate([[0], np.searchsorted(self.keys, self.bounds), [len(self.keys)]]).tolist()
        for bucket, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                lang, words, phrase = zip(*[self.phrases[i] for i in self.place[a:b].tolist()])
                values = [pa.array(lang, pa.string()), pa.array(words, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(self.counts[self.place[a:b]])]
                whole = pa.array([0, b - a], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.ListArray.from_arrays(whole, v) for v in values]], ["bucket", "lang", "words", "phrase", "n"])
        self.clear()


PACKED_TEXTS = "bucket int, lang array<string>, words array<int>, phrase array<string>, n array<long>"


def _texts(limit: int, buckets: int, candidates) -> Mapper:
    def run(batches: Batches) -> Batches:
        held = Texts(buckets)
        for batch, rows, b in blocks(batches, limit):
            names = batch.column(0).take(pa.array(rows, pa.int64())).to_pylist()
            for k in range(1, WORDS + 1):
                at = np.flatnonzero(b.whole(k))
                held.add(b, k, at[candidates.value.holds(b.key(k)[at])], names)
            if len(held.phrases) >= HELD_TEXTS:
                yield from held.rows()
        yield from held.rows()
    return run


def exact_counts(packed: DataFrame, support: int) -> DataFrame:
    """lang, words, phrase, n of the phrases that reach the support in all packed rows together, compared by text."""
    def merge(rows: pa.Table) -> pa.Table:
        flat = pa.table({c: pa.chunked_array([x.flatten() for x in rows.column(c).chunks]) for c in ("lang", "words", "phrase", "n")})
        total = flat.group_by(["lang", "words", "phrase"]).aggregate([("n", "sum")])
        total = total.filter(pc.greater_equal(total.column("n_sum"), support))
        return pa.table({c: total.column(c if c != "n" else "n_sum") for c in ("lang", "words", "phrase", "n")})

    ship(packed.sparkSession)
    return packed.groupBy("bucket").applyInArrow(merge, "lang string, words int, phrase string, n long")


def _exact_ceiling(support: int) -> str:
    """ceil(support * of_shard / of_lang)"""
    return f"cast((cast(of_shard as decimal(20,0)) * {support} + of_lang - 1) div of_lang as long)"


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, bits: int = BITS, limit: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """lang, words, phrase, n of all phrases of one to WORDS words with at least `support` occurrences; and lang, of_lang (all words)."""
    context = docs.sparkSession.sparkContext
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("l"), F.xxhash64(lang, F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))).alias("g"), "text")
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    words = staged(mapped(rows, _packed(limit, buckets, _words), PACKED), "words")
    of_shard = words.select(F.explode("totals").alias("t")).groupBy("t.lang", "t.g").agg(F.sum("t.n").alias("of_shard"))
    totals = staged(of_shard.groupBy("lang").agg(F.sum("of_shard").alias("of_lang")), "totals")
    least = staged(of_shard.join(totals.where(F.col("of_lang") >= support), "lang").select("g", F.expr(_exact_ceiling(support)).alias("least")), "support")
    buckets = max(buckets, (totals.agg(F.sum("of_lang")).first()[0] or 0) // BUCKET_WORDS)

    def mined(starts: Starts) -> DataFrame:
        return staged(locally_frequent(mapped(rows, _packed(limit, buckets, starts), PACKED), least), "mined")

    one = staged(locally_frequent(words, least), "mined")
    known_words = context.broadcast(bit_set(one, bits, salted=True))
    two = mined(_pairs(known_words))
    known_pairs = context.broadcast(bit_set(two, bits, salted=True))
    more = mined(_longer(known_pairs))
    candidates = context.broadcast(bit_set(one.union(two).union(more), bits, salted=False))
    found = staged(exact_counts(mapped(rows, _texts(limit, buckets, candidates), PACKED_TEXTS), support), "phrases")
    for used in (known_words, known_pairs, candidates):
        used.destroy()
    return found, totals


# Scores -------------------------------------------------------------------------------------------------------------

def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase of two words or more, by its lowest-scoring cut."""
    parts = F.split("phrase", " ")
    cuts = phrases.where("words > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "cut", F.array_join(F.slice(parts, F.lit(1), F.col("cut")), " ").alias("left"),
                       F.array_join(F.slice(parts, F.col("cut") + 1, F.col("words")), " ").alias("right"))
    known = phrases.select("lang", "phrase", "n")
    cuts = (cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
            .join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]))
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)").alias("score")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score, "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def absorbed(phrases: DataFrame) -> DataFrame:
    """lang, phrase, longest: the highest frequency of a longer frequent phrase around each phrase of two words or more."""
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, k), " "))))
    around = phrases.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "n")
    return around.groupBy("lang", "phrase").agg(F.max("n").alias("longest"))


def collocations(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, top: int = TOP, bits: int = BITS, limit: int = SLICE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    phrases, totals = frequent_phrases(docs, support, shards, bits, limit)
    rest = scored(phrases).join(absorbed(phrases), ["lang", "phrase"], "left")
    rest = rest.where(F.expr("longest is null or cast(longest as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * 80"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("of_lang").alias("n"), "score")


ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a
      FROM w, (VALUES (1), (2), (3), (4)) AS ks(k), unnest(range(1, len(ws) - k + 2)) AS u(i) GROUP BY ALL HAVING count(*) >= {SUPPORT}),
c AS (SELECT *, string_split(phrase, ' ') AS ps FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, cut, (2000000::HUGEINT * c.a // (x.a + y.a))::BIGINT AS score
         FROM c, unnest(range(1, c.k)) AS u(cut) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ps[1:cut], ' ')
         JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ps[cut + 1:c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
around AS (SELECT lang, array_to_string(ps[i:i + m - 1], ' ') AS phrase, max(a) AS longest
           FROM c, unnest(range(2, k)) AS u(m), unnest(range(1, k - m + 2)) AS v(i) GROUP BY ALL),
rest AS (SELECT best.* FROM best LEFT JOIN around USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM rest JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""
