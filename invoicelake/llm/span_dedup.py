"""Repeated passages by sliding spans of sentences and of pieces.

A text is cut twice: into sentences (behind . ! or ? when white space follows, and at line ends), and into pieces at
places that only the words around them decide: a piece begins at every word whose hash is the smallest (the last of equal
ones) in some `WINDOW` consecutive words. Pieces have at most `WINDOW` words and do not depend on marks, on line ends or on what
stands before, so a passage without marks has equal pieces wherever it stands.

Spans are runs of sentences, and runs of pieces: from each one onwards, and up to each one, as few as reach `MIN_WORDS` words;
`SPAN` sentences are a span however short. They are hashed over their words (letters A-Z as a-z; marks and white space do
not count). Spans are joined over all documents on the hash: a span belongs to the document with the smallest doc_id that
has it, at its first place there. Every other occurrence is a repeat, and all words that a repeat covers are removed.

Of a passage of 51 words (2 * `WINDOW` + `MIN_WORDS` - 1 = 50, or more) two documents have the same run of pieces with `MIN_WORDS`
words or more, and all of that run goes; less than `WINDOW` words at either end of a passage can stay, none if it begins and ends
with a sentence. Sentences shared whole go when they are `SPAN` or have `MIN_WORDS` words together.

Only (hash, row) pairs are shuffled to find the hashes of several rows, one per row and different span, counted with
partial aggregation, so a passage that a third of the documents share is never gathered. A row then gets the list of
its repeated hashes (bounded by its length) and is cut in one pass.

Cases: null and empty texts and texts of fewer than `SPAN` sentences and `MIN_WORDS` words have no spans and stay as they are (null
becomes empty); sentences without words belong to the sentence before. Characters of scripts written without white space
(U+3000 to U+9FFF) are words of their own. Null doc_ids come after all others; rows that repeat a doc_id, or have none, are
rows of their own, and the one of the smallest row number is first. Columns other than doc_id and text are ignored by the report.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoicelake.llm.words import FOLDED, INSIDE, Mapper, Words, mapped, mix, run_hashes, text_slices
from invoicelake.session import staged

SPAN = 3
MIN_WORDS = 25
WINDOW = 13
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_WHITE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))


class Units(Words):
    """Words; characters from U+3000 to U+9FFF (three bytes, the first from E3 to E9) are words of their own."""

    def __init__(self, texts: list[bytes]):
        super().__init__(texts)
        single = np.flatnonzero((self.data >= 0xE3) & (self.data <= 0xE9))
        if len(single):
            cuts = np.union1d(single, single + 3)
            inner = cuts[INSIDE[self.data[cuts]] & INSIDE[self.data[cuts - 1]] & (cuts > 0)]
            self.start, self.end = np.union1d(self.start, inner), np.union1d(self.end, inner)
            self.hash = run_hashes(FOLDED[self.data], self.start, self.end)
            self.first = np.searchsorted(self.start, np.concatenate([self.offset, [len(self.data)]]))
            self.count = np.diff(self.first)
            self.text = np.repeat(np.arange(len(texts)), self.count)


def _runs(first: np.ndarray, stop: np.ndarray, text: np.ndarray, min_words: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(begin, end) in words of the shortest runs of units, from each unit and up to each, with `min_words` words or `most` units."""
    i = np.arange(len(first))
    last = np.minimum(np.searchsorted(stop, first + min_words), i + most - 1)
    begin = np.maximum(np.searchsorted(first, stop - min_words, "right") - 1, i - most + 1)
    onwards = np.flatnonzero((last < len(first)) & (text[np.minimum(last, len(first) - 1)] == text))
    upto = np.flatnonzero((begin >= 0) & (text[np.maximum(begin, 0)] == text))
    return [(first[onwards], stop[last[onwards]]), (first[begin[upto]], stop[upto])]


class Sentences:
    """The sentences of some texts as ranges of words, and the spans: ranges of words in order, with text and hash."""

    def __init__(self, words: Words, span: int = SPAN, min_words: int = MIN_WORDS, window: int = WINDOW):
        n = len(words.hash)
        ends = _STOP[words.data]
        ends[:-1] &= _WHITE[words.data[1:]]
        ends |= (words.data == 10) | (words.data == 13)
        passed = np.concatenate([[0], np.cumsum(ends)])[words.start]
        other = np.ones(n, bool)
        other[1:] = words.text[1:] != words.text[:-1]
        new = other.copy()
        new[1:] |= passed[1:] != passed[:-1]
        self.first = np.flatnonzero(new)
        self.stop = np.concatenate([self.first[1:], [n]]).astype(np.int64) if n else self.first
        self.text = words.text[self.first]
        ranges = _runs(self.first, self.stop, self.text, min_words, span) if n else []
        if n >= window:
            cut = other.copy()
            at = np.flatnonzero(words.text[window - 1:] == words.text[:n - window + 1])
            cut[at + window - 1 - np.lib.stride_tricks.sliding_window_view(mix(words.hash), window)[:, ::-1].argmin(axis=1)[at]] = True
            first = np.flatnonzero(cut)
            ranges += _runs(first, np.concatenate([first[1:], [n]]), words.text[first], min_words, n)
        ranges = [(a, b, run_hashes(words.hash, a, b)) for a, b in ranges if len(a)]
        a, b, h = (np.concatenate([r[k] for r in ranges]) for k in range(3)) if ranges else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
        order = np.lexsort((b, a))
        a, b, h = a[order], b[order], h[order]
        once = np.ones(len(a), bool)
        once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.at, self.to, self.span = a[once], b[once], h[once]
        self.of = words.text[self.at] if len(self.at) else self.at


def _spans(span: int, min_words: int) -> Mapper:
    """(row, doc, check, span): one per row and different span."""
    def run(batches):
        for batch, texts in text_slices(batches):
            s = Sentences(Units(texts), span, min_words)
            order = np.lexsort((s.span, s.of))
            t, h = s.of[order], s.span[order]
            keep = np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])]) if len(t) else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(t[keep])) for c in range(3)), pa.array(h[keep].view(np.int64))], ["row", "doc", "check", "span"])
    return run


def _cut(span: int, min_words: int) -> Mapper:
    """Remove the words of repeats; `repeats` are the hashes that belong to another row."""
    def run(batches):
        for batch, texts in text_slices(batches):
            words = Units(texts)
            s = Sentences(words, span, min_words)
            foreign = batch.column(batch.schema.get_field_index("repeats")).to_pylist()
            lines = np.searchsorted(s.text, np.arange(len(texts) + 1))
            spans = np.searchsorted(s.of, np.arange(len(texts) + 1)).tolist()
            depth = np.zeros(len(words.hash) + 1, np.int64)
            for i in range(len(texts)):
                hashes = s.span[spans[i]:spans[i + 1]]
                again = np.ones(len(hashes), bool)
                again[np.unique(hashes, return_index=True)[1]] = False
                if foreign[i]:
                    again |= np.isin(hashes.view(np.int64), np.array(foreign[i], np.int64))
                np.add.at(depth, s.at[spans[i]:spans[i + 1]][again], 1)
                np.add.at(depth, s.to[spans[i]:spans[i + 1]][again], -1)
            gone = np.cumsum(depth)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            whole = np.concatenate([[0], np.cumsum(total[s.stop] - total[s.first] == s.stop - s.first)])
            out, ranges = [], []
            for i, text in enumerate(texts):
                low, high = int(words.first[i]), int(words.first[i + 1])
                # a word reaches to the first byte of the next, so marks go with it
                starts = np.concatenate([words.start[low:high] - words.offset[i], [len(text)]])
                edge = np.flatnonzero(np.diff(gone[low:high].astype(np.int8), prepend=0, append=0))
                runs = starts[edge].reshape(-1, 2).tolist()
                kept, last = [], 0
                for a, b in runs:
                    kept.append(text[last:a])
                    last = b
                kept.append(text[last:])
                out.append(b"".join(kept).decode("utf-8", "replace"))
                ranges.append([{"start": len(text[:a].decode()), "end": len(text[:b].decode())} for a, b in runs])
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(lines), pa.int64()), pa.array(np.diff(whole[lines]), pa.int64()), pa.array(ranges, kinds), pa.array(out, pa.string())],
                                             ["doc_id", "n_sentences", "n_removed", "removed", "text"])
    return run


def repeated_spans(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, check, repeats): for every row the spans it shares with a row of a smaller doc_id, or of the same and a smaller row. `docs` has row."""
    rows = docs.select("row", F.col("doc_id").alias("doc"), F.xxhash64("text").alias("check"), "text")
    spans = staged(mapped(rows, _spans(span, min_words), f"row long, doc {dict(rows.dtypes)['doc']}, check long, span long"), "spans")
    shared = spans.groupBy("span").count().where("count > 1").select("span")
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "row").alias("place")
    copies = staged(spans.join(shared, "span").select("span", "row", "check", place), "copies")
    firsts = copies.groupBy("span").agg(F.min("place").alias("first"))
    return copies.join(firsts, "span").where("not (place <=> first)").groupBy("row").agg(F.first("check").alias("check"), F.collect_list("span").alias("repeats"))


def without_repeats(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_sentences, n_removed (whole sentences), removed (code points), text (what is left)."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    found = repeated_spans(rows, span, min_words)
    same = F.col("check").isNull() | F.col("check").eqNullSafe(F.xxhash64("text"))
    repeats = F.when(same, F.col("repeats")).otherwise(F.raise_error(F.lit("the documents changed between two scans")))
    joined = rows.join(found, "row", "left").select("doc_id", "text", repeats.alias("repeats"))
    kind = f"doc_id {dict(rows.dtypes)['doc_id']}, n_sentences long, n_removed long, removed array<struct<start:int,end:int>>, text string"
    return mapped(joined, _cut(span, min_words), kind)
