"""Personal data: base patterns, and a skip-chain conditional random field over the mentions of a document.

Base spans are found by four patterns (email, ip, card, phone; see `base_spans`). Further mentions are pieces that look
like personal data but match no pattern: digit groups, things around an @, and numbers joined by dots. The mentions of a document are
the nodes of a conditional random field with labels none, email, ip, card, phone:

- node potentials from features of the mention's shape and of the words next to it;
- chain edges between neighbours in the text;
- skip edges between mentions that repeat (equal characters without marks) or are similar (equal last seven digits, equal
  name before the @), however far apart. Mentions with one key are linked in a row, so a key with n mentions makes n - 1
  edges.

Loopy sum-product message passing (parallel, damped) gives the marginals; base mentions are held at their kind, so a
document's certain mentions pull the doubtful ones with them. A further mention becomes a span when one kind reaches
`MIN_MARGINAL`. Base spans always stay.

The weights are fitted by pseudo-likelihood on a bounded sample: the mentions of the `SAMPLE_DOCS` documents with the smallest
hash of doc_id and text among those that have a digit or an @, at most `SAMPLE_MENTIONS` each. Base spans are the kinds, mentions
linked to one by skip edges are unobserved, and all other mentions are none, which is what distant supervision can say; features
that spell out a pattern are left out. Skip weights are learned from pairs of base spans, each with its label masked and
judged by the other's alone, so they say how far equal mentions have equal kinds.

Cases: null and empty texts have no spans; texts are read whole and documents are judged alone, so repeated rows get equal
results; spans of one kind never overlap, and a further mention that touches a base span is dropped. Without sample
documents the weights are zero and only base spans are returned. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoicelake.llm.words import Mapper, mapped

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE_DOCS, SAMPLE_MENTIONS = 2000, 200
MIN_MARGINAL = 0.6
ROUNDS, DAMPING, TOLERANCE = 25, 0.5, 1e-4
STEPS, RATE, DECAY = 150, 0.5, 1e-3
HASHED = 64

#: The four patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # the same matches as without look-behind and ++, in linear time
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:[.-][0-9]++)++")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern: each starts at the first of the characters in front of an @ and after the last match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of the base spans in order, and the digit groups and dotted numbers that are none."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    groups: list[tuple[int, int]] = []
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(int(p) <= 255 if len(p.lstrip("0")) < 4 else False for p in m[0].split(".")):
                found.append((1, *m.span()))
            else:
                groups.append(m.span())
        groups += [m.span() for m in DOTTED.finditer(text) if "." in m[0]]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
            else:
                groups.append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((3, *m.span()))
                else:
                    groups.append(m.span())
    return found, groups


class Mention:
    __slots__ = ("start", "end", "label", "keys", "features")

    def __init__(self, text: str, start: int, end: int, label: int | None):
        self.start, self.end, self.label = start, end, label
        body = text[start:end]
        digits = re.sub(r"[^0-9]", "", body)
        self.keys = []
        if "@" in body:
            self.keys.append("@" + body.split("@")[0].lower())
        elif len(digits) >= 7:
            self.keys.append(digits[-7:])
        plain = re.sub(r"[^0-9a-z]", "", body.lower())
        if len(plain) >= 6:
            self.keys.append("=" + plain)
        before = re.search(r"(\w+)\W*$", text[max(0, start - 24):start])
        after = re.match(r"\W*(\w+)", text[end:end + 24])
        self.features = [0, 1 + ("@" in body), 3 + min(len(digits), 20), 24 + min(body.count("."), 4), 29 + min(len(re.findall(r"[0-9]+", body)), 6),
                         36 + _bucket("b" + before[1].lower() if before else "b"), 36 + HASHED + _bucket("a" + after[1].lower() if after else "a")]


N_FEATURES = 36 + 2 * HASHED


def _bucket(word: str) -> int:
    return hashlib.blake2b(word.encode(), digest_size=2).digest()[0] % HASHED


def mentions(text: str) -> tuple[list[tuple[int, int, int]], list[Mention]]:
    """Base spans, and all mentions in the order of the text; base mentions carry their label."""
    base, groups = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    further = {(a, b) for a, b in groups if sum(c.isdigit() for c in text[a:b]) >= 7 or IP.fullmatch(text, a, b)}
    if "@" in text:
        at = text.find("@")
        while at >= 0:
            a, b = at, at + 1
            while a > 0 and not text[a - 1].isspace() and text[a - 1] != "@":
                a -= 1
            while b < len(text) and not text[b].isspace() and text[b] != "@":
                b += 1
            if b - a > 3:
                further.add((a, b))
            at = text.find("@", at + 1)
    nodes = [Mention(text, a, b, k + 1) for k, a, b in base]
    starts = np.array([a for a, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else np.empty(0, np.int64)
    end = -1
    for a, b in sorted(further, key=lambda f: (f[0], -f[1])):
        i = int(np.searchsorted(starts, b)) - 1
        if (i < 0 or reach[i] <= a) and a >= end:
            nodes.append(Mention(text, a, b, None))
            end = b
    nodes.sort(key=lambda m: (m.start, m.end))
    return base, nodes


def edges(nodes: list[Mention]) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges and skip edges, as pairs of node numbers."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1)]
    last: dict[str, int] = {}
    skip = set()
    for i, m in enumerate(nodes):
        for key in m.keys:
            if key in last and last[key] != i:
                skip.add((last[key], i))
            last[key] = i
    return np.array(chain, np.int64).reshape(-1, 2), np.array(sorted(skip), np.int64).reshape(-1, 2)


class Field:
    """Weights of the random field: node features by label, and label pairs for chain and skip edges."""

    def __init__(self):
        k = len(LABELS)
        self.node, self.chain, self.skip = np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros((k, k))
        self.fitted = False

    def marginals(self, nodes: list[Mention]) -> np.ndarray:
        """Loopy message passing; base mentions are held at their label."""
        k, n = len(LABELS), len(nodes)
        own = np.array([self.node[m.features].sum(axis=0) for m in nodes])
        for i, m in enumerate(nodes):
            if m.label is not None:
                own[i] = np.where(np.arange(k) == m.label, 0.0, -50.0)
        chain, skip = edges(nodes)
        ends = np.concatenate([chain, skip])
        pair = np.concatenate([np.broadcast_to(self.chain, (len(chain), k, k)), np.broadcast_to(self.skip, (len(skip), k, k))])
        source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
        weight = np.exp(np.concatenate([pair, pair.transpose(0, 2, 1)]))
        m, back = len(ends), None
        message = np.zeros((2 * m, k))
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, target, message)
            out = belief[source] - message[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ek,ekl->el", out, weight) + 1e-300)
            new -= np.log(np.exp(new - new.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + new.max(axis=1, keepdims=True)
            new = DAMPING * message + (1 - DAMPING) * new
            moved = np.abs(new - message).max() if m else 0.0
            message = new
            if moved < TOLERANCE:
                break
        belief = own.copy()
        np.add.at(belief, target, message)
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)

    def fit(self, documents: list[list[Mention]]) -> "Field":
        """Gradient ascent on the pseudo-likelihood: every observed label given its neighbours' labels."""
        nodes = [m for doc in documents for m in doc]
        if not nodes:
            return self
        k, base = len(LABELS), np.cumsum([0] + [len(d) for d in documents])
        label = np.array([m.label or 0 for m in nodes])
        feature = np.array([m.features for m in nodes])
        links = [(edges(d), b) for d, b in zip(documents, base)]
        chain, skip = (np.concatenate([e[j] + b for e, b in links]) for j in (0, 1))
        linked = label > 0
        while True:  # what a base mention reaches over skip edges is unobserved
            more = linked.copy()
            more[skip[linked[skip[:, 0]], 1]] = more[skip[linked[skip[:, 1]], 0]] = True
            if (more == linked).all():
                break
            linked = more
        seen = (label > 0) | ~linked
        chain, skip = chain[seen[chain].all(axis=1)], skip[(label[skip] > 0).all(axis=1)]
        want = np.eye(k)[label]
        for _ in range(STEPS):
            score, alone = self.node[feature].sum(axis=1), np.zeros((len(nodes), k))
            for ends, w, to in ((chain, self.chain, score), (skip, self.skip, alone)):
                np.add.at(to, ends[:, 0], w[:, label[ends[:, 1]]].T)
                np.add.at(to, ends[:, 1], w[label[ends[:, 0]], :])
            off, off_skip = (want - p / p.sum(axis=1, keepdims=True) for p in (np.exp(x - x.max(axis=1, keepdims=True)) for x in (score, alone)))
            off = off * seen[:, None]
            grad = np.zeros_like(self.node)
            for j in range(feature.shape[1]):
                np.add.at(grad, feature[:, j], off)
            self.node += RATE * (grad / seen.sum() - DECAY * self.node)
            for ends, w, d in ((chain, self.chain, off), (skip, self.skip, off_skip)):
                if len(ends):
                    g = np.zeros((k, k))
                    np.add.at(g.T, label[ends[:, 1]], d[ends[:, 0]])
                    np.add.at(g, label[ends[:, 0]], d[ends[:, 1]])
                    w += RATE * (g / len(ends) - DECAY * w)
        self.fitted = True
        return self


def find(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and further spans of a text, as (kind, start, end)."""
    if "@" not in text and not DIGITS.search(text):
        return [], []
    base, nodes = mentions(text)
    if not field.fitted or all(m.label is not None for m in nodes):
        return base, []
    chance = field.marginals(nodes)
    best = chance.argmax(axis=1)
    return base, [(int(best[i]) - 1, m.start, m.end) for i, m in enumerate(nodes)
                  if m.label is None and best[i] > 0 and chance[i, best[i]] >= MIN_MARGINAL]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_mentions: int = SAMPLE_MENTIONS) -> Field:
    """Weights from a bounded sample; of the sample only the mentions reach the driver.

    The sample is found on hashes alone, so no task holds texts that are not in it. Of a text with more mentions every second,
    third, ... one is taken.
    """
    rows = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]")).withColumn("order", F.xxhash64("doc_id", "text"))
    last = rows.select("order").distinct().orderBy("order").limit(sample_docs).agg(F.max("order")).first()[0]
    picked = rows.where(F.col("order") <= F.lit(last)).dropDuplicates(["order"]).select("text")

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                nodes = mentions(text)[1]
                nodes = nodes[::max(1, -(-len(nodes) // sample_mentions))]
                out.append([{"label": m.label or 0, "keys": m.keys, "features": m.features} for m in nodes])
            kind = pa.list_(pa.struct([("label", pa.int32()), ("keys", pa.list_(pa.string())), ("features", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([pa.array(out, kind)], ["nodes"])

    documents = []
    for r in mapped(picked, run, "nodes array<struct<label:int,keys:array<string>,features:array<int>>>").collect():
        doc = []
        for n in r["nodes"]:
            m = object.__new__(Mention)
            m.label, m.keys, m.features = n["label"] or None, list(n["keys"]), list(n["features"])
            doc.append(m)
        documents.append(doc)
    return Field().fit(documents)


def _spans(shared) -> Mapper:
    def run(batches):
        for batch in batches:
            counts, base_text, all_text, further = [], [], [], []
            for text in batch.column(1).to_pylist():
                base, more = find(text or "", shared.value)
                counts.append([sum(k == i for k, _, _ in base) for i in range(len(KINDS))])
                base_text.append(listed(base))
                all_text.append(listed(base + more))
                further.append(len(more))
            columns = list(zip(*counts)) if counts else [()] * len(KINDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(base_text, pa.string()), pa.array(all_text, pa.string()), pa.array(further, pa.int64())],
                                             ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_further"])
    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_further."""
    field = docs.sparkSession.sparkContext.broadcast(fit(docs))
    rows = docs.select("doc_id", "text")
    kind = f"doc_id {dict(rows.dtypes)['doc_id']}, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string, n_further long"
    return mapped(rows, _spans(field), kind)


def report(docs: DataFrame) -> DataFrame:
    """`personal_data` with the digest of the base spans."""
    return personal_data(docs).select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_further")
