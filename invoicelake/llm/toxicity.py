"""Toxicity by nearest labelled examples under exact TF-IDF cosine, over a block-max inverted index.

Training. At most `LABELLED` labelled rows of each class (smallest hash of doc_id), never held-out ones, are the examples;
equal texts count once. Terms are words and their beginnings (`PREFIXES` bytes), as insults are often stems, and each of
them seen `REPEATS` times or more, as a cosine alone does not tell one mention from many. The vocabulary
are the terms that go with the label among the examples (in `MIN_TOXIC` toxic ones or more, with more nats of
evidence than the log of the number of examples, and a raise of the odds), at most `TERMS`. Texts without one of them are compared
by all their words with the examples within a cosine of `RADIUS` instead, in a second index. Document frequencies of both are counted
over all documents; a word of no example counts in a text's length as a word of one document. Vectors are (1 + log tf) * idf, length one.

Index. For every term the examples that hold it, in blocks of `BLOCK` examples, with the largest weight per block. For a
query the sum of (query weight * block maximum) bounds every cosine in a block. Blocks are scored in falling order of their
bound, some at a time, until the bound is below the k-th best cosine, so the k nearest are exact. Examples with equal vectors are one entry
with two counts, and entries are laid out by their heaviest term, which keeps the bounds tight.

Score. Neighbours vote with their cosine: the vote is the toxic share of the weights, drawn towards the share among
examples without vocabulary terms. A monotone table over the examples, each judged without itself, turns votes into
calibrated scores. Evidence is the number of entries that voted and the best cosine. Over all words
any two texts are a little similar, so there only examples within `RADIUS` vote, with the cosine to the power of `SHARPNESS` (a cosine
below it would count less than 2 percent), and the table is made from the examples without vocabulary terms, each judged without
itself and once as a copy of itself. Texts without an example within `RADIUS` have the share of the examples without vocabulary terms.

Cases: null and empty texts and texts without a word of any example have no neighbours; their score is the toxic share of
the examples without vocabulary terms. Labels with null doc_id or null toxic are ignored; of several labels for one doc_id the smallest counts; a null
doc_id is not held out. Without examples of both classes the score is the share of toxic examples (0 if there are none). Ties
between neighbours go to the earlier entry. Repeated rows get equal results; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoicelake.llm.words import CHUNK, FOLDED, Mapper, Words, mapped, mix, run_hashes, text_slices

LABELLED = 10_000
TERMS = 4096
NEIGHBOURS = 25
BLOCK = 64
PREFIXES = (4, 5, 6, 7, 8)
REPEATS = (2, 3, 5)
MIN_ODDS, MIN_TOXIC = 3.0, 3
SHARPNESS = 8
RADIUS = 0.6
LEVELS = 32
PRIOR_WEIGHT = 0.1
DECISION = 0.7
REMEMBERED = 50_000


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, size: int = LABELLED) -> DataFrame:
    """text and y of the examples, equal ones once: a bounded number of labelled rows that are not held out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("y"))
    picked = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        picked = part if picked is None else picked.union(part)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most 2 * size rows
    return found.select(F.coalesce("text", F.lit("")).alias("text"), "y").distinct()


def _terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word and of the beginnings of every word."""
    texts, hashes = [words.text], [words.hash]
    size = words.end - words.start
    for n in PREFIXES:
        longer = np.flatnonzero(size > n)
        texts.append(words.text[longer])
        hashes.append(mix(run_hashes(FOLDED[words.data], words.start[longer], words.start[longer] + n) + np.uint64(n)))
    return np.concatenate(texts), np.concatenate(hashes)


def _distinct(text: np.ndarray, hashes: np.ndarray, repeats: tuple = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash, times, plain term) for every distinct term of every text, repeats included, in order."""
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    at = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])])) if len(t) else np.empty(0, np.int64)
    t, h, n = t[at], h[at], np.diff(np.concatenate([at, [len(t)]]))
    many = [(t[n >= r], mix(h[n >= r] + np.uint64(r)), h[n >= r]) for r in repeats]
    plain = np.concatenate([h, *(m[2] for m in many)])
    times = np.concatenate([n, np.ones(len(plain) - len(h), n.dtype)])
    t, h = np.concatenate([t, *(m[0] for m in many)]), np.concatenate([h, *(m[1] for m in many)])
    order = np.lexsort((h, t))
    return t[order], h[order], times[order], plain[order]


def _example_counts(batches):
    """(word, plain, clean, toxic): in how many examples of either class each term occurs."""
    for batch, texts in text_slices(batches):
        t, h, _, plain = _distinct(*_terms(Words(texts)))
        y = np.array(batch.column(1).to_pylist(), np.int64)[t] if len(t) else t
        word, first, group = np.unique(h, return_index=True, return_inverse=True)
        toxic = np.bincount(group, y, len(word)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(plain[first].view(np.int64)),
                                          pa.array(np.bincount(group, minlength=len(word)) - toxic), pa.array(toxic)], ["word", "plain", "clean", "toxic"])


def choose_terms(counts: DataFrame, clean: int, toxic: int, terms: int = TERMS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of terms (and of their plain terms) that go with the label: n * KL(share of toxic || base share) and raise of the odds, the strongest first."""
    n, base = F.col("clean") + F.col("toxic"), toxic / (clean + toxic)
    share = F.col("toxic") / n
    gain = n * (share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0))
    best = counts.where(F.col("toxic") >= MIN_TOXIC).select("word", "plain", gain.alias("gain"), (share * (1 - base) >= MIN_ODDS * base * (1 - share)).alias("raised"))
    picked = best.where((F.col("gain") > math.log(clean + toxic) + 1e-6) & F.col("raised")).orderBy(F.desc("gain"), "word").limit(terms).collect()
    return tuple(np.array([r[c] for r in picked], np.int64).view(np.uint64) for c in ("word", "plain"))


class Vectors:
    """TF-IDF vectors over a chosen vocabulary, or over whole words only."""

    def __init__(self, terms: np.ndarray, plain: np.ndarray, whole: bool = False):
        self.whole = whole
        self.terms, self.plain = np.unique(terms), np.unique(plain)
        self.idf = np.ones(len(self.terms))

    def find(self, text: np.ndarray, word: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.terms):
            return text[:0], np.empty(0, np.int64), times[:0]
        at = np.minimum(np.searchsorted(self.terms, word), len(self.terms) - 1)
        hit = self.terms[at] == word
        return text[hit], at[hit], times[hit]

    def weights(self, text: np.ndarray, term: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        raw = (1 + np.log(times)) * self.idf[term]
        norm = np.sqrt(np.bincount(text, raw * raw, n))
        return raw / norm[text]


class Index:
    """Block-max inverted index over example vectors; equal vectors are one entry."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, terms: int):
        groups: dict[bytes, list] = {}
        for (term, weight), label in zip(vectors, y.tolist()):
            if len(term):
                entry = groups.setdefault(term.tobytes() + np.round(weight, 12).tobytes(), [term, weight, 0, 0])
                entry[3 if label else 2] += 1
        entries = sorted(groups.values(), key=lambda e: (int(e[0][np.argmax(e[1])]), -float(e[1].max()), e[0].tobytes(), e[1].tobytes()))
        self.clean, self.toxic = (np.array([e[k] for e in entries], np.int64) for k in (2, 3))
        self.n, self.blocks = len(entries), -(-len(entries) // BLOCK)
        entry = np.repeat(np.arange(len(entries)), [len(e[0]) for e in entries])
        term = np.concatenate([e[0] for e in entries]) if entries else np.empty(0, np.int64)
        weight = np.concatenate([e[1] for e in entries]) if entries else np.empty(0)
        order = np.lexsort((entry, term))
        self.entry, self.weight = entry[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(terms + 1))
        key = term[order] * max(1, self.blocks) + self.entry // BLOCK
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        self.block, self.highest = (self.entry // BLOCK)[at], np.maximum.reduceat(self.weight, at) if len(at) else np.empty(0)
        self.start = np.concatenate([at, [len(key)]])
        self.block_first = np.searchsorted(term[order][at], np.arange(terms + 1))
        self.entry, self.block = self.entry.astype(np.int32), self.block.astype(np.int32)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, without: tuple | None = None) -> list[tuple[float, int, int]]:
        """(cosine, entry, examples) of the k nearest examples with a positive cosine; `without` is one example to leave out."""
        at, query = _ranges(self.block_first[term], self.block_first[term + 1], weight)
        bound = np.bincount(self.block[at], query * self.highest[at], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        cosine, entry, n = np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
        done, step, least = 0, 4, 0.0
        while done < len(order) and bound[order[done]] >= least - 1e-12:
            chosen = np.zeros(self.blocks, bool)
            chosen[order[done:done + step]] = True
            of = chosen[self.block[at]]
            posting, w = _ranges(self.start[at[of]], self.start[at[of] + 1], query[of])
            score = np.bincount(self.entry[posting], w * self.weight[posting], self.n)
            new = np.flatnonzero(score > 0)
            copies = self.clean[new] + self.toxic[new] - (new == without[0] if without is not None else 0)
            cosine, entry, n = np.concatenate([cosine, score[new]]), np.concatenate([entry, new]), np.concatenate([n, copies])
            best = np.lexsort((entry, -np.round(cosine, 12)))
            best = best[n[best] > 0]
            total = np.cumsum(n[best])
            if len(total) and total[-1] >= k:
                best = best[:int(np.searchsorted(total, k)) + 1]
                least = cosine[best[-1]]
            cosine, entry, n = cosine[best], entry[best], n[best]
            done, step = done + step, step * 4
        return list(zip(cosine.tolist(), entry.tolist(), n.tolist()))


def _ranges(first: np.ndarray, end: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, one range after the other, and the weight of each position's range."""
    size = end - first
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size), np.repeat(weight, size)


class Model:
    """Vocabulary, index, and the table from votes to scores; `rest` is the model for texts without vocabulary terms."""

    def __init__(self, vectors: Vectors, index: Index, prior: float, power: int = 1):
        self.vectors, self.index, self.prior, self.power = vectors, index, prior, power
        self.rest: Model | None = None
        self.votes, self.scores = np.array([0.0, 1.0]), np.array([prior, prior])

    def vote(self, found: list[tuple[float, int, int]], k: int = NEIGHBOURS, without: tuple | None = None) -> float:
        toxic, total, left = PRIOR_WEIGHT * self.prior, PRIOR_WEIGHT, k
        for cosine, e, n in found:
            bad = int(self.index.toxic[e]) - (without is not None and without[0] == e and without[1] == 1)
            weight = cosine ** self.power * min(n, left)
            toxic += weight * bad / n
            total += weight
            left -= min(n, left)
        return toxic / total

    def score(self, vote: float) -> float:
        return float(np.interp(vote, self.votes, self.scores))


def calibrate(votes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the monotone table closest to the labels; shares are drawn a little to the middle."""
    value, group = np.unique(np.round(votes, 9), return_inverse=True)
    toxic, total = np.bincount(group, weight * y), np.bincount(group, weight)
    pools: list[list[float]] = []
    for v, bad, n in zip(value.tolist(), toxic.tolist(), total.tolist()):
        pools.append([v, v, bad, n])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    x, s = [], []
    for low, high, bad, n in pools:
        value = (bad + 0.5 * 0.02) / (n + 0.02)
        x += [low, high] if high > low else [low]
        s += [value] * (2 if high > low else 1)
    return np.array(x), np.array(s)


def fit(docs: DataFrame, labels: DataFrame, size: int = LABELLED, terms: int = TERMS) -> Model:
    """Learn from the examples; only bounded things reach the driver: the vocabulary and the examples' vectors over it."""
    from invoicelake.session import staged

    spark = docs.sparkSession
    chosen = staged(examples(docs, labels, size), "examples")
    sizes = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Model(Vectors(np.empty(0, np.uint64), np.empty(0, np.uint64)), Index([], np.empty(0), 0), toxic / max(1, clean + toxic))
    counts = mapped(chosen, _example_counts, "word long, plain long, clean long, toxic long")
    counts = counts.groupBy("word", "plain").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    vectors = Vectors(*choose_terms(counts, clean, toxic, terms))
    weighted, y = _weighted(docs, chosen, vectors)
    # the classes are sampled at different rates; `ratio` gives clean examples their real share
    known = labels.where(F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id"))).groupBy("toxic").count().collect()
    real = {r["toxic"]: r["count"] for r in known}
    weight = np.where(y == 1, real.get(1, 1) / toxic, real.get(0, 1) / clean)
    bare = np.array([not len(t) for t, _ in weighted])
    prior = (float(weight[bare & (y == 1)].sum()) + 0.01) / (float(weight[bare].sum()) + 1.0)
    model = Model(vectors, Index(weighted, y, len(vectors.terms)), prior)
    place = {e: i for i, e in enumerate(_entry_keys(model.index, weighted))}
    votes = np.full(len(y), prior)
    for i, (t, w) in enumerate(weighted):
        if len(t):
            own = place.get(_key(t, w), -1), int(y[i])
            votes[i] = model.vote(model.index.nearest(t, w, without=own), without=own)
    model.votes, model.scores = calibrate(votes, y, weight)
    model.rest = _rest(docs, chosen, vectors, {1: real.get(1, 1) / toxic, 0: real.get(0, 1) / clean}, prior)
    return model


def _weighted(docs: DataFrame, chosen: DataFrame, vectors: Vectors) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The examples' vectors and labels; sets the idf."""
    frequency, n_docs = document_frequency(docs, vectors)
    vectors.idf = np.log((1 + n_docs) / (1 + frequency)) + 1
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    weighted, y = [], []
    for doc in mapped(chosen, _projected(shared), "y int, terms array<int>, times array<int>").orderBy("y", "terms", "times").toLocalIterator():
        t = np.array(doc["terms"], np.int64)
        weighted.append((t, vectors.weights(np.zeros(len(t), np.int64), t, np.array(doc["times"], np.float64), 1)))
        y.append(doc["y"])
    shared.destroy()
    return weighted, np.array(y)


class Nearby:
    """Block-max inverted index over all words of the examples; finds the nearest ones with a cosine of `RADIUS` or more.

    `words` are sorted hashes with their idf; a posting is (word, example, times). Lists are cut into blocks of `BLOCK` postings.
    """

    def __init__(self, words: np.ndarray, idf: np.ndarray, rare: float, entry: np.ndarray, term: np.ndarray, times: np.ndarray, y: np.ndarray, keys: np.ndarray):
        self.words, self.idf, self.rare, self.keys, self.toxic, self.n = words, idf, rare, keys, y, len(y)
        order = np.argsort(term.astype(np.int64) * max(1, self.n) + entry)
        self.entry, self.times, of = entry[order].astype(np.int32), times[order].astype(np.int32), term[order].astype(np.int32)
        del order
        parts = [slice(i, i + CHUNK) for i in range(0, len(of), CHUNK)]  # 64-bit numbers of a part of the postings at a time
        raw = lambda part: (1 + np.log(self.times[part])) * idf[of[part]]
        squares = np.zeros(self.n)
        for part in parts:
            squares += np.bincount(self.entry[part], raw(part) ** 2, self.n)
        self.norm = np.sqrt(squares)
        self.levels = np.linspace(idf.min(initial=0.0), idf.max(initial=1.0), LEVELS)
        mass, weight = np.zeros(LEVELS * self.n), np.empty(len(of), np.float32)
        for part in parts:
            exact = raw(part) / self.norm[self.entry[part]]
            level = np.minimum(np.searchsorted(self.levels, idf[of[part]]), LEVELS - 1)
            mass += np.bincount(level * self.n + self.entry[part], exact * exact, LEVELS * self.n)
            weight[part] = exact
        self.length = np.sqrt(np.cumsum(mass.reshape(LEVELS, self.n), axis=0))  # of every example's words with an idf up to each level
        self.first = np.searchsorted(of, np.arange(len(words) + 1))
        at, begin = _ranges(np.zeros(len(words), np.int64), -(-np.diff(self.first) // BLOCK), self.first[:-1])
        at = begin + at * BLOCK
        self.block_first = np.searchsorted(of[at], np.arange(len(words) + 1))
        self.block = np.concatenate([at, [len(of)]])
        self.highest = np.maximum.reduceat(weight, at) * (1 + 1e-6) if len(at) else np.empty(0)  # not below the exact weights
        self.top = np.maximum.reduceat(self.highest, self.block_first[:-1]) if len(words) else np.empty(0)

    def queries(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of every text, the rarest terms first; words of no example count in the length as words of one document."""
        words = Words(texts)
        text, hashes, times, _ = _distinct(words.text, words.hash, ())
        at = np.minimum(np.searchsorted(self.words, hashes), max(0, len(self.words) - 1))
        hit = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        raw = (1 + np.log(times)) * (np.where(hit, self.idf[at], self.rare) if len(self.words) else self.rare)
        norm = np.sqrt(np.bincount(text, raw * raw, len(texts)))
        text, at, weight = text[hit], at[hit], raw[hit] / norm[text[hit]]
        order = np.lexsort((at, -self.idf[at], text))
        at, weight = at[order], weight[order]
        first = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        return [(at[a:b], weight[a:b]) for a, b in zip(first[:-1], first[1:])]

    def _exact(self, term: np.ndarray, weight: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """The cosines of the candidates: each is looked up in the list of each term."""
        out = np.empty(len(candidates))
        step = max(1, (1 << 20) // max(1, len(term)))
        for i in range(0, len(candidates), step):
            some = candidates[i:i + step]
            low = np.repeat(self.first[term][:, None], len(some), 1)
            high = np.repeat(self.first[term + 1][:, None], len(some), 1)
            end = high.copy()
            while (low < high).any():
                middle = (low + high) // 2
                less = (self.entry[np.minimum(middle, len(self.entry) - 1)] < some) & (low < high)
                low, high = np.where(less, middle + 1, low), np.where(less, high, np.minimum(high, middle))
            at = np.minimum(low, len(self.entry) - 1)
            held = np.where((low < end) & (self.entry[at] == some), 1 + np.log(self.times[at]), 0.0)
            out[i:i + step] = (weight * self.idf[term]) @ held / self.norm[some]
        return out

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, radius: float = RADIUS, without: int = -1) -> list[tuple[float, int, int]]:
        """(cosine, example, 1) of the k nearest examples with a cosine of `radius` or more, for a query of `queries`.

        An example that shares only the terms behind a cut cannot come nearer than their length, nor than the sum of their bounds. So
        lists are read up to the first cut where one of both is below `radius`; of these lists the blocks whose bound is below
        are left out. The terms behind the cut add at most their length times the length of the example's equally common words; what
        can still reach `radius` is computed in full.
        """
        bound = weight * self.top[term]
        behind = np.minimum(np.sqrt(np.cumsum((weight * weight)[::-1])[::-1]), np.cumsum(bound[::-1])[::-1])
        least = radius - 1e-9
        cut = int(np.searchsorted(-behind, -least, "right"))  # `behind` falls: terms before the cut can matter
        if not cut:
            return []
        rest = behind[cut] if cut < len(term) else 0.0
        ahead = np.cumsum(bound[:cut])[-1] - bound[:cut] + rest
        block, other = _ranges(self.block_first[term[:cut]], self.block_first[term[:cut] + 1], ahead)
        _, query = _ranges(self.block_first[term[:cut]], self.block_first[term[:cut] + 1], weight[:cut])
        _, idf = _ranges(self.block_first[term[:cut]], self.block_first[term[:cut] + 1], self.idf[term[:cut]])
        keep = query * self.highest[block] + other >= least
        at, factor = _ranges(self.block[block[keep]], self.block[block[keep] + 1], (query * idf)[keep])
        entry = self.entry[at]
        partial = np.bincount(entry, factor * (1 + np.log(self.times[at])) / self.norm[entry], self.n)
        if cut < len(term):
            level = min(int(np.searchsorted(self.levels, self.idf[term[cut]])), LEVELS - 1)
            rest = np.minimum(rest, np.sqrt(np.sum(weight[cut:] ** 2)) * self.length[level] + 1e-9)
        candidates = np.flatnonzero((partial > 0) & (partial + rest >= least))
        candidates = candidates[candidates != without]
        if not len(candidates):
            return []
        cosine = self._exact(term, weight, candidates)
        best = np.lexsort((candidates, -np.round(cosine, 12)))
        best = best[cosine[best] >= least][:k]
        return [(float(cosine[i]), int(candidates[i]), 1) for i in best]


def _example_words(batches):
    """The different words of every slice of examples."""
    for _, texts in text_slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(Words(texts).hash).view(np.int64))], ["word"])


def _packed(shared) -> Mapper:
    """One row per slice of examples: (key, label, size) of its examples and (term, times) of their words, as packed arrays."""
    def run(batches):
        for batch, texts in text_slices(batches):
            found = Words(texts)
            text, hashes, times, _ = _distinct(found.text, found.hash, ())
            columns = (batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64),
                       np.bincount(text, minlength=len(texts)).astype(np.int64), np.searchsorted(shared.value, hashes).astype(np.int32), times.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["key", "y", "size", "term", "times"])
    return run


def _nearby(docs: DataFrame, chosen: DataFrame) -> Nearby:
    """The index over all words of the examples. They are bounded, and come to the driver as packed numbers, a partition at a time."""
    words = np.sort(mapped(chosen, _example_words, "word long").distinct().toArrow()["word"].to_numpy().view(np.uint64))
    frequency, n_docs = document_frequency(docs, Vectors(words, words, True))
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1
    shared = docs.sparkSession.sparkContext.broadcast(words)
    rows = mapped(chosen.select("text", "y", F.xxhash64("text", "y").alias("key")), _packed(shared), "key binary, y binary, size binary, term binary, times binary")
    kinds = {"key": np.int64, "y": np.int64, "size": np.int64, "term": np.int32, "times": np.int32}
    parts: dict[str, list] = {name: [np.empty(0, kind)] for name, kind in kinds.items()}
    for row in rows.toLocalIterator():
        for name, kind in kinds.items():
            parts[name].append(np.frombuffer(row[name], kind))
    shared.destroy()
    key, y, size, term, times = (np.concatenate(parts.pop(name)) for name in kinds)
    order = np.argsort(key, kind="stable")
    place = np.empty(len(key), np.int32)
    place[order] = np.arange(len(key))
    return Nearby(words, idf, math.log((1 + n_docs) / 2) + 1, np.repeat(place, size), term, times, y[order], key[order])


def _rest(docs: DataFrame, chosen: DataFrame, vectors: Vectors, share: dict[int, float], prior: float) -> Model:
    """The model over all words of the examples, its table made from those without a term of `vectors`."""
    model = Model(vectors, _nearby(docs, chosen), prior, SHARPNESS)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model))

    def run(batches):
        vectors, model = shared.value
        for batch, texts in text_slices(batches):
            known = np.bincount(vectors.find(*_distinct_of(vectors, Words(texts)))[0], minlength=len(texts))
            kinds, keys = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out: list[tuple[int, float]] = []
            for i, (t, w) in enumerate(model.index.queries(texts)):
                if known[i] or not len(t):
                    continue
                own = int(np.searchsorted(model.index.keys, keys[i]))
                out += [(kinds[i], model.vote(model.index.nearest(t, w))), (kinds[i], model.vote(model.index.nearest(t, w, without=own)))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([v for _, v in out], pa.float64())], ["y", "vote"])

    keyed = chosen.select("text", "y", F.xxhash64("text", "y").alias("key"))
    judged = mapped(keyed, run, "y int, vote double").orderBy("y", "vote").toArrow()  # at most two for each example
    shared.destroy()
    if judged.num_rows:
        kinds = judged["y"].to_numpy()
        model.votes, model.scores = calibrate(judged["vote"].to_numpy(), kinds, np.where(kinds == 1, share[1], share[0]))
    return model


def _vectors_of(vectors: Vectors, words: Words, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, weights) of each of `n` texts."""
    t, term, times = vectors.find(*_distinct_of(vectors, words))
    order = np.lexsort((term, t))
    t, term, times = t[order], term[order], times[order]
    weight = vectors.weights(t, term, times, n)
    first = np.searchsorted(t, np.arange(n + 1)).tolist()
    return [(term[a:b], weight[a:b]) for a, b in zip(first[:-1], first[1:])]


def _key(t: np.ndarray, w: np.ndarray) -> bytes:
    return t.tobytes() + np.round(w, 12).tobytes()


def _entry_keys(index: Index, vectors: list) -> list[bytes]:
    groups = {_key(t, w): (t, w) for t, w in vectors if len(t)}
    return sorted(groups, key=lambda k: (int(groups[k][0][np.argmax(groups[k][1])]), -float(groups[k][1].max()), groups[k][0].tobytes(), groups[k][1].tobytes()))


def _projected(shared) -> Mapper:
    """The vocabulary terms of every example."""
    def run(batches):
        for batch, texts in text_slices(batches):
            t, at, n = shared.value.find(*_distinct_of(shared.value, Words(texts)))
            order = np.lexsort((at, t))
            first = np.searchsorted(t, np.arange(len(texts) + 1)).tolist()
            lists = [[x[order][a:b].astype(np.int32) for a, b in zip(first[:-1], first[1:])] for x in (at, n)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x, pa.list_(pa.int32())) for x in lists)], ["y", "terms", "times"])
    return run


def document_frequency(docs: DataFrame, vectors: Vectors) -> tuple[np.ndarray, int]:
    """In how many of all documents each vocabulary word occurs, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        seen, n = np.zeros(len(shared.value.terms) + 1, np.int64), 0
        for _, texts in text_slices(batches):
            words = Words(texts)
            _, term, _ = shared.value.find(*_distinct_of(shared.value, words))
            seen[:-1] += np.bincount(term, minlength=len(seen) - 1)
            n += len(texts)
        seen[-1] = n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "n"])

    rows = mapped(docs.select("text"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(len(vectors.terms) + 1, np.int64)
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return out[:-1], int(out[-1])


def _distinct_of(vectors: Vectors, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_distinct`, looking only at terms of the vocabulary."""
    text, hashes = (words.text, words.hash) if vectors.whole else _terms(words)
    if not len(vectors.plain):
        return text[:0], hashes[:0], text[:0]
    at = np.minimum(np.searchsorted(vectors.plain, hashes), len(vectors.plain) - 1)
    hit = vectors.plain[at] == hashes
    return _distinct(text[hit], hashes[hit], () if vectors.whole else REPEATS)[:3]


def _score(shared) -> Mapper:
    def run(batches):
        model: Model = shared.value
        known: dict[bytes, tuple[float, int, float]] = {}  # results of vectors seen in this task
        for batch, texts in text_slices(batches):
            words = Words(texts)
            chosen = _vectors_of(model.vectors, words, len(texts))
            whole = model.rest.index.queries(texts) if model.rest else chosen
            score, near, top = [], [], []
            for of_chosen, of_whole in zip(chosen, whole):
                use, (t, w) = (model, of_chosen) if len(of_chosen[0]) or not model.rest else (model.rest, of_whole)
                key = bytes([use is model]) + hashlib.blake2b(_key(t, w), digest_size=16).digest()
                if key not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    found = use.index.nearest(t, w) if len(t) else []
                    known[key] = use.score(use.vote(found)) if found else use.prior, len(found), found[0][0] if found else 0.0
                for column, value in zip((score, near, top), known[key]):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(near, pa.int32()), pa.array(top, pa.float64())], ["doc_id", "score", "n_near", "best_cosine"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, size: int = LABELLED, terms: int = TERMS, decision: float = DECISION) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted, n_near (entries that voted), best_cosine."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, size, terms))
    rows = docs.select("doc_id", "text")
    scored = mapped(rows, _score(model), f"doc_id {dict(rows.dtypes)['doc_id']}, score double, n_near int, best_cosine double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= decision).cast("int").alias("predicted"), "n_near", "best_cosine")


def crc_held_out(doc_id: int) -> bool:
    """`is_held_out` for one id, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
