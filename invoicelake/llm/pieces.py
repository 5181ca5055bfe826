"""SentencePiece encoding and decoding by streaming Viterbi over a public piece vocabulary.

The encoding of a text is the segmentation with the largest sum of piece scores, the scores being those of the vocabulary
file. Characters that no piece holds are written as byte pieces, each character at a cost below every piece. The search
keeps scores only for a window of as many characters as the longest piece. Whenever all paths that may still survive
(those ending in the window) run through one boundary, the ids in front of it are committed and forgotten.

In a vocabulary whose pieces hold blanks only in front, all paths meet at every change from a word to a blank, and around
every character without a piece. Such boundaries are known beforehand, so a text is taken apart there, and the ids of a part
of at most `MEMO_CHARS` characters are kept for the next time, in a memory of bounded size. Longer parts are streamed.

Form of a text: one blank is put in front, a blank is the mark U+2581 of the vocabulary, and nothing else is changed; the
character U+2581 itself is written in bytes. So decoding gives back every text exactly.

Cases: null is kept as empty; an empty text has no ids; ties in the sum prefer the longer last piece; texts of any length
are encoded whole, with memory for the window and the ids; rows are independent, so repeated rows get equal ids. Columns
other than `text` are passed on or ignored and may have any name.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invoicelake.llm.words import Mapper, mapped, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MEMO_CHARS = 48
MEMO_PARTS = 700_000
BLANK = "▁"


class Vocabulary:
    """Pieces with ids and scores, and the ids of the 256 bytes."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=os.path.realpath(path))
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        self.piece: dict[str, tuple[int, float]] = {}
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                self.bytes_of.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                plain = name.replace(BLANK, " ")
                self.piece[plain] = i, model.get_score(i)
                self.bytes_of.append(plain.encode())
        self.finish()

    def finish(self) -> None:
        """Work out the window, the cost of bytes, and whether texts can be taken apart at blanks."""
        self.window = max(map(len, self.piece), default=1)
        self.bytes_score = min((s for _, s in self.piece.values()), default=0.0) - 10.0
        #: every beginning of a piece, with id and score if it is a piece itself
        self.begins = {p[:k]: self.piece.get(p[:k], ()) for p in self.piece for k in range(1, len(p) + 1)}
        apart = all(re.fullmatch(r" *[^ ]*", p) for p in self.piece) and not any("\n" in p for p in self.piece)
        self.parts = re.compile(r"\n| *[^ \n]+| +" if apart else r"(?s).+")


class Encoder(dict):
    """Streaming Viterbi for one worker; as a dictionary it is the memory of parts, which fills itself."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary

    def encode(self, text: str) -> bytes:
        """The ids of a text, as 32-bit integers."""
        return b"".join(map(self.__getitem__, self.v.parts.findall(" " + text))) if text else b""

    def __missing__(self, part: str) -> bytes:
        if len(part) > MEMO_CHARS:
            return np.fromiter(self.stream(part), np.int32).tobytes()
        ids = np.array(self.short(part), np.int32).tobytes()
        if len(self) >= MEMO_PARTS:
            self.clear()
        self[part] = ids
        return ids

    def short(self, text: str) -> list[int]:
        """The search of `stream` for a part so short that nothing needs to be committed before its end."""
        v, n = self.v, len(text)
        get, window = v.begins.get, v.window
        score, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        for i in range(n):
            here = score[i]
            if not get(text[i]):
                total = here + v.bytes_score
                if total > score[i + 1]:
                    score[i + 1], back[i + 1] = total, (i, -1)
            for j in range(i + 1, min(i + window, n) + 1):
                hit = get(text[i:j])
                if hit is None:
                    break
                if hit and here + hit[1] > score[j]:
                    score[j], back[j] = here + hit[1], (i, hit[0])
        return self._ids(text, back, 0, n)

    def stream(self, text: str):
        """Yield the ids; `score` and `back` only hold boundaries that are not committed."""
        v, n = self.v, len(text)
        score, back = {0: 0.0}, {}
        done, check = 0, 2 * v.window
        for i in range(n):
            here = score[i]
            char = text[i]
            ways = [(1, here + v.bytes_score, -1)] if char not in v.piece else []
            for size in range(1, min(v.window, n - i) + 1):
                piece = text[i:i + size]
                hit = v.begins.get(piece)
                if hit is None:
                    break
                if hit:
                    ways.append((size, here + hit[1], hit[0]))
            for size, total, number in ways:
                if i + size not in score or total > score[i + size]:
                    score[i + size], back[i + size] = total, (i, number)
            score.pop(i - v.window, None)
            if i + 1 - done >= check and i + 1 < n:
                meet = self._meeting(back, done, i + 1)
                if meet > done:
                    yield from self._ids(text, back, done, meet)
                    for b in range(done + 1, meet + 1):
                        back.pop(b, None)
                    done, check = meet, 2 * v.window
                else:
                    check *= 2
        if n > done:
            yield from self._ids(text, back, done, n)

    def _meeting(self, back: dict, done: int, end: int) -> int:
        """The last boundary that the paths to all boundaries in the window before and after `end` have in common."""
        heads = {b for b in back if b >= end}
        heads |= {end}
        while len(heads) > 1:
            last = max(heads)
            heads.discard(last)
            heads.add(back[last][0] if last > done else done)
        return max(done, heads.pop())

    def _ids(self, text: str, back, begin: int, end: int) -> list[int]:
        out: list[int] = []
        while end > begin:
            start, number = back[end]
            if number >= 0:
                out.append(number)
            else:
                out.extend(reversed([self.v.byte_id[b] for b in text[start:end].encode()]))
            end = start
        return out[::-1]


def decode(vocabulary: Vocabulary, ids) -> bytes:
    """The text of some ids, in UTF-8."""
    table = vocabulary.bytes_of
    return b"".join([table[i] for i in ids])[1:]


_encoders: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker process and vocabulary, so that its memory serves later tasks as well."""
    key = str(id(shared.value)) if not hasattr(shared.value, "name") else shared.value.name
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def load(spark: SparkSession, path: str = MODEL):
    """The vocabulary as a broadcast variable; its size is that of the vocabulary file."""
    vocabulary = Vocabulary(path)
    vocabulary.name = f"{path}:{len(vocabulary.bytes_of)}"
    return spark.sparkContext.broadcast(vocabulary)


def _encode(shared) -> Mapper:
    def run(batches):
        encoder = _encoder(shared)
        for batch, texts in text_slices(batches):
            ids = [np.frombuffer(encoder.encode(t.decode()), np.int32) for t in texts]
            exact = [decode(shared.value, i.tolist()) == t for i, t in zip(ids, texts)]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            column = batch.schema.get_field_index("text")
            rest = [c for k, c in enumerate(batch.columns) if k != column]
            yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(exact)],
                                             [*(n for k, n in enumerate(batch.schema.names) if k != column), "ids", "round_trip"])
    return run


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """One row per row of `docs`: doc_id, ids, round_trip (decoding gives the text back)."""
    rows = docs.select("doc_id", "text")
    return mapped(rows, _encode(load(docs.sparkSession, path)), f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, round_trip boolean")


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids are empty."""
    shared = load(rows.sparkSession, path)

    def run(batches):
        for batch in batches:
            texts = [decode(shared.value, ids or ()).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    picked = rows.select("doc_id", "ids")
    return mapped(picked, run, f"doc_id {dict(picked.dtypes)['doc_id']}, text string")


def tokens(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """`encoded` with the number of ids, for reports."""
    return encoded(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def best_sum(vocabulary: Vocabulary, ids) -> float:
    """The sum of scores of some ids; a character in bytes counts once."""
    name = {i: s for i, s in vocabulary.piece.values()}
    total, run = 0.0, b""
    for i in [*ids, None]:
        if i is not None and i not in name:
            run += vocabulary.bytes_of[i]
            continue
        total += len(run.decode()) * vocabulary.bytes_score + (name[i] if i is not None else 0.0)
        run = b""
    return total
