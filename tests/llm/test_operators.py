"""Brute-force comparisons and odd inputs for the document operators."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from invoicelake.llm import decontam, exact_dedup, jaccard_join, line_dedup, pieces, pii, quality, span_dedup, toxicity, warc
from invoicelake.llm.words import Words, mix

DOCS = "doc_id long, text string, lang string, row long, n_hit string"
LONG = "word " * 40_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns whose names clash with the operators' own."""
    rows = [(1, None, None, 1, "x"), (2, "", "en", 1, "x"), (3, LONG, "en", 1, "x"), (None, "a b c d e f g h i j k", "en", None, None),
            (4, "one two. three four. five six. seven", "en", 1, "x"), (4, "one two. three four. five six. seven", "en", 1, "x"),
            (5, "one two. three four. five six.", None, 2, "y"), (6, "line a\nline b\nline c", "en", 3, "z"), (7, "line a\nline b\nother", "en", 3, "z"), (8, " \t\n", "en", 3, "z")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "five six"), (3, None), (4, ""), (None, "other")], "item_id long, text string")


def test_odd_inputs_keep_every_row(spark, odd, labels, bench):
    n = odd.count()
    for result in (pii.report(odd), toxicity.toxicity(odd, labels), quality.resample(odd, labels), exact_dedup.exact_duplicates(odd), span_dedup.without_repeats(odd),
                   decontam.report(odd, bench), line_dedup.without_copies(odd), jaccard_join.classes(odd), pieces.tokens(odd)):
        assert result.count() == n


def test_empty_tables(spark, odd, labels, bench):
    none = odd.limit(0)
    for result in (pii.report(none), toxicity.toxicity(none, labels.limit(0)), quality.resample(none, labels), exact_dedup.exact_duplicates(none), span_dedup.without_repeats(none),
                   decontam.report(odd, bench.limit(0)).where("contaminated"), line_dedup.without_copies(none), jaccard_join.classes(none), pieces.tokens(none),
                   warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"))):
        assert result.count() == 0


def test_filters_keep_all_columns(spark, odd, labels, bench):
    for result in (quality.sampled(odd, labels), exact_dedup.without_duplicates(odd), jaccard_join.one_per_class(odd), decontam.without_contaminated(odd, bench)):
        assert result.columns == odd.columns
        result.collect()
    assert exact_dedup.without_duplicates(odd).count() == 8  # one of two equal rows, and one of null and empty, go


def test_exact_groups(spark):
    rows = spark.createDataFrame([(5, "a  b"), (3, "a\tb"), (9, "a b "), (None, "a b"), (7, "a b"), (7, "a b")], "doc_id long, text string").repartition(5)
    got = [r for r in exact_dedup.exact_duplicates(rows, fan=2).collect() if r.group_size > 1]
    assert {r.keep_id for r in got} == {3} and {r.group_size for r in got} == {5} and sum(r.kept for r in got) == 1


def test_decontamination_blocks_agree(spark, odd, bench):
    one = sorted(map(str, decontam.report(odd, bench).collect()))
    assert one == sorted(map(str, decontam.report(odd, bench, block_bytes=10).collect()))
    hit = {(r.doc_id, r.n_hit) for r in decontam.report(odd, bench).collect() if r.contaminated}
    assert hit == {(None, 11), (4, 2), (5, 2), (7, 1)}


def brute_similar(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[0-9a-z]+", t.lower())
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def test_similarity_join_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = {}
    for i in range(30):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(120)] = f"x{i}"
        texts[i] = " ".join(words)
    texts |= {100 + i: " ".join(f"y{rng.randrange(10**6)}" for _ in range(50)) for i in range(10)}
    pairs = brute_similar(texts)
    links = dict.fromkeys(texts, 0)
    sets = {i: " ".join(t.split()) for i, t in texts.items()}
    for a in texts:
        links[a] = len({sets[b] for b in texts if (min(a, b), max(a, b)) in pairs})
    got = jaccard_join.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in got} == links
    root = {i: min(j for j in texts if sets[j] == sets[i]) for i in texts}
    for _ in texts:
        for a, b in pairs:
            low = min(root[a], root[b])
            root = {i: low if r in (root[a], root[b]) else r for i, r in root.items()}
    assert {r.doc_id: r.class_id for r in got} == root


def test_bands_reach_the_recall():
    bands, rows = jaccard_join.plan_bands(0.8, 0.999)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.999 and bands * rows <= jaccard_join.MAX_HASHES


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(2)
    values = [int(v) for v in rng.integers(-(1 << 62), 1 << 62, 300)] + [5] * 20 + [-5] * 20 + [-(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "o long")
    for k in (1, 2, 150, 170, len(values)):
        assert quality.kth_largest(df, "o", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "o", len(values) + 1) is None


def test_resampling_prefers_the_target(spark):
    rng = random.Random(3)
    good = [(i, " ".join(rng.choices("alpha beta gamma delta".split(), k=60))) for i in range(200)]
    junk = [(1000 + i, " ".join(rng.choices("## %% zz qq".split(), k=60))) for i in range(60)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 2)] + [(1000 + i, 0) for i in range(0, 60, 2)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.resample(docs, labels).where("kept").collect()}
    assert kept == {i for i, _ in good}
    assert quality.resample(docs, labels, k=50).where("kept").count() == 50
    assert {r.doc_id for r in quality.sampled(docs, labels).collect()} == kept


def whole_search(encoder, text):
    v, n = encoder.v, len(text)
    score, back = [0.0] + [-1e300] * n, [None] * (n + 1)
    for i in range(n):
        if text[i] not in v.piece and score[i] + v.bytes_score > score[i + 1]:
            score[i + 1], back[i + 1] = score[i] + v.bytes_score, (i, -1)
        for j in range(i + 1, min(n, i + v.window) + 1):
            hit = v.piece.get(text[i:j])
            if hit and score[i] + hit[1] > score[j]:
                score[j], back[j] = score[i] + hit[1], (i, hit[0])
    return encoder._ids(text, back, 0, n)


def test_streaming_search_equals_the_whole_search():
    encoder = pieces.Encoder(pieces.Vocabulary())
    rng = random.Random(4)
    for alphabet in ("abcdething", "a", "the of▁ñß€漢 \n", "ab \n"):
        for size in (0, 1, 30, 700):
            text = "".join(rng.choices(alphabet, k=size))
            want = whole_search(encoder, " " + text) if text else []
            got = np.frombuffer(encoder.encode(text), np.int32).tolist()
            assert got == want == (list(encoder.stream(" " + text)) if text else [])
            assert pieces.decode(encoder.v, got) == text.encode()


def test_decode_round_trip(spark, odd):
    back = {(r.doc_id, r.text) for r in pieces.decoded(pieces.tokens(odd)).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd.collect()}


def test_spans_against_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(2, 6))) + "." for _ in range(12)]
    docs = {i: " ".join(rng.choices(pool, k=rng.randrange(0, 9))) for i in range(40)}
    owner, want = {}, {}
    for i in sorted(docs):
        s = re.findall(r"[^.]+\.", docs[i])
        s = [x.strip() for x in s]
        gone = set()
        for k in range(len(s) - 2):
            if owner.setdefault(tuple(s[k:k + 3]), (i, k)) != (i, k):
                gone |= {k, k + 1, k + 2}
        want[i] = [x for k, x in enumerate(s) if k not in gone]
    got = span_dedup.without_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: [x.strip() for x in re.findall(r"[^.]+\.", r.text)] for r in got} == want


def test_passages_of_51_words_go_whatever_surrounds_them(spark):
    rng = random.Random(10)
    def some(n, end=""):
        return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n)) + end
    bare, two = some(60), some(30, ". ") + some(30, ".")
    four = [some(10), some(14, ". "), some(14, ". "), some(12)]
    wide = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(60))
    docs = {}
    for k, passage in enumerate((bare, two, "".join(four[:1]) + ". " + "".join(four[1:]), wide)):
        for copy in (0, 1, 2):
            docs[10 * k + copy] = f"{some(7 + 12 * copy)} {passage} {some(9 + 5 * copy)}" if passage is not wide else f"{some(2)} {some(1)}{passage}{some(3)}"
    got = {r.doc_id: r for r in span_dedup.without_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)).collect()}
    word = re.compile("[0-9a-z]+|[\u3000-\u9fff]")
    for i, text in docs.items():
        left, first = word.findall(got[i].text), word.findall(docs[i - i % 10])
        runs = {tuple(first[k:k + 51]) for k in range(len(first) - 50)}
        mine = set(word.findall(text)) - set(first)
        assert i % 10 == 0 and got[i].text == text or mine <= set(left) and not any(tuple(left[k:k + 51]) in runs for k in range(len(left) - 50))
        assert i % 10 == 0 or len(set(left) & set(first)) < 2 * span_dedup.WINDOW


def test_passages_repeated_among_rows_without_an_id_go(spark):
    passage = " ".join(f"p{k}" for k in range(60)) + "."
    rows = [(None, f"a{k}. {passage} b{k}.") for k in range(4)] + [(7, f"c{k}. other {passage.replace('p', 'q')} d{k}.") for k in range(3)] + [(None, "c. " + passage.replace("p", "q"))]
    got = span_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sum("p30" in r.text for r in got) == 1
    assert [r.doc_id for r in got if "q30" in r.text] == [7]
    assert len(got) == 8 and all(f"b{k}." in " ".join(r.text for r in got) for k in range(4))


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_line_runs_against_brute_force(spark, size):
    rng = random.Random(size)
    docs = {i: "\n".join(rng.choices(["a", " b", "c ", "", "d", "e"], k=rng.randrange(0, 12))) for i in range(30)}
    seen, want = set(), {}
    for i in sorted(docs):
        lines = docs[i].split("\n")
        full = [k for k, x in enumerate(lines) if x.strip()]
        gone = set()
        for p in range(len(full) - size + 1):
            run = tuple(lines[k].strip() for k in full[p:p + size])
            if run in seen:
                gone.update(full[p:p + size])
            seen.add(run)
        want[i] = sorted(gone)
    got = line_dedup.without_copies(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), size).collect()
    assert {r.doc_id: list(r.removed) for r in got} == want


def test_long_lines_are_runs_of_their_own(spark):
    long, wide, nine = " ".join(f"w{k}" for k in range(60)), "".join(map(chr, range(0x4E00, 0x4E20))), " ".join("abcdefghi")
    docs = {i: f"top {i}\n{nine}\nmid {i}\n {long} \n\nnext {i}\n{wide}\nlast {i}" for i in range(3)} | {3: long, 4: long, 5: nine}
    got = line_dedup.without_copies(spark.createDataFrame([*docs.items(), (None, long)], "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: list(r.removed) for r in got} == {0: [], 1: [3, 6], 2: [3, 6], 3: [0], 4: [0], 5: [], None: [0]}
    assert {r.doc_id: r.text for r in got}[1] == f"top 1\n{nine}\nmid 1\n\nnext 1\nlast 1"


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_base_patterns_against_the_plain_expressions():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choices("a1.@-+ ()b23é_%", k=rng.randrange(40)))
        want = [(0, *m.span()) for m in EMAIL.finditer(text)]
        want += [(1, *m.span()) for m in pii.IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(3, *m.span()) for m in pii.PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        got = [s for s in pii.base_spans(text)[0] if s[0] != 2]
        assert sorted(got) == sorted(want)
    assert pii.base_spans("pay 4111 1111 1111 1111 or 4111-1111-1111-1112")[0] == [(2, 4, 23)]


def test_skip_edges_carry_a_label_to_a_distant_mention():
    field = pii.Field()
    field.fitted = True
    field.node[0, 0] = 1.0
    field.skip[:] = 3 * np.eye(len(pii.LABELS))
    text = "call +1 (988) 555-2485 now. " + "filler " * 50 + "again 988 555-2485 please, order 1234567890"
    base, more = pii.find(text, field)
    assert [k for k, _, _ in base] == [3]
    assert [text[a:b] for _, a, b in more] == ["988 555-2485"] and more[0][0] == 3
    assert pii.find(text, pii.Field())[1] == []


def test_a_fitted_field_labels_a_distant_unmarked_repeat():
    rng = random.Random(12)
    texts = []
    for k in range(120):
        number = f"{rng.randrange(200, 999)} {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
        ip = ".".join(str(rng.randrange(1, 255)) for _ in range(4))
        again = [f"again {number} please", f"call +1 {number} now", "nothing", f"host {ip} twice"][k % 4]
        texts.append(f"call +1 {number} now. host {ip} up. order {rng.randrange(10**9, 10**10)} came. " + "filler " * 20 + again)
    field = pii.Field().fit([pii.mentions(t)[1] for t in texts])
    for number in ("988 555-2485", "988.555.2485"):
        text = "call +1 (988) 555-2485 now. " + "filler " * 50 + f"again {number} please, order 1234567890 came"
        _, more = pii.find(text, field)
        assert [(k, text[a:b]) for k, a, b in more] == [(3, number)]
    text = "at 10.0.0.300 and 988.555.2485, 1.2.3.400"
    assert [text[m.start:m.end] for m in pii.mentions(text)[1]] == ["10.0.0.300", "988.555.2485", "1.2.3.400"]


def test_messages_are_exact_on_a_chain():
    rng = np.random.default_rng(7)
    field = pii.Field()
    field.node, field.chain = rng.normal(size=field.node.shape), rng.normal(size=field.chain.shape)
    nodes = [pii.Mention(f"{k}{'9' * (7 + k)}", 0, 8 + k, None) for k in range(4)]
    for i, m in enumerate(nodes):
        m.keys = []
    k, own = len(pii.LABELS), [field.node[m.features].sum(axis=0) for m in nodes]
    want = np.zeros((4, k))
    for states in np.ndindex(*(k,) * 4):
        p = np.exp(sum(o[s] for o, s in zip(own, states)) + sum(field.chain[a, b] for a, b in zip(states, states[1:])))
        for i, s in enumerate(states):
            want[i, s] += p
    assert np.allclose(field.marginals(nodes), want / want.sum(axis=1, keepdims=True), atol=1e-3)


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(8)
    vectors, y = [], rng.integers(0, 2, 400)
    for _ in y:
        term = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        w = rng.random(len(term)) + 0.1
        vectors.append((term, w / np.linalg.norm(w)))
    index = toxicity.Index(vectors, y, 60)
    dense = np.zeros((400, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for _ in range(50):
        t = np.sort(rng.choice(60, 5, replace=False))
        w = np.full(5, 5 ** -0.5)
        q = np.zeros(60)
        q[t] = w
        want = np.sort((dense @ q)[dense @ q > 0])[::-1][:25]
        got = [c for c, _, n in index.nearest(t, w) for _ in range(n)][:25]
        assert np.allclose(got, want)


def test_nearest_examples_by_all_words_are_exact():
    rng = np.random.default_rng(12)
    n, size = 300, 500
    share = 1 / np.arange(1, size + 1)
    texts = [rng.choice(size, rng.integers(1, 60), p=share / share.sum()) for _ in range(n)]
    texts += [np.concatenate([t[:len(t) - len(t) // 4], rng.choice(size, len(t) // 4)]) for t in texts[:150]]
    joined = [" ".join(f"w{k}" for k in t).encode() for t in texts]
    hashes = toxicity.Words([" ".join(f"w{k}" for k in range(size)).encode()]).hash
    counts = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        np.add.at(counts[i], t, 1)
    idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))) + 1
    known = np.flatnonzero(counts[:n].sum(axis=0))
    known = known[np.argsort(hashes[known])]
    rare = 6.5
    idf[counts[:n].sum(axis=0) == 0] = rare
    entry, term = np.nonzero(counts[:n][:, known])
    index = toxicity.Nearby(hashes[known], idf[known], rare, entry, term, counts[:n][:, known][entry, term], np.zeros(n, int), np.arange(n))
    dense = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    some = 0
    for i, (t, w) in enumerate(index.queries(joined)):
        cosine = dense[:n] @ dense[i]
        if i < n:
            cosine[i] = 0
        for radius in (0.3, 0.45, toxicity.RADIUS):
            want = np.sort(cosine[cosine >= radius])[::-1][:toxicity.NEIGHBOURS]
            got = index.nearest(t, w, radius=radius, without=i if i < n else -1)
            assert np.allclose([c for c, _, _ in got], want)
            assert all(np.isclose(cosine[e], c) for c, e, _ in got)
            some += len(got)
    assert some > 300
    assert index.nearest(*index.queries([b""])[0]) == [] and index.nearest(*index.queries([b"unseen"])[0]) == []


def test_toxicity_learns_only_from_rows_not_held_out(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=40) + (["vile", "vile"] if i % 5 == 0 else []))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    wrong = labels.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1 then 1 - toxic else toxic end as toxic")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[i].predicted == int(i % 5 == 0) and got[i].held_out == toxicity.crc_held_out(i) for i in got)
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs, wrong).collect()} == {i: r.score for i, r in got.items()}


def test_a_copy_of_a_toxic_example_is_toxic_without_chosen_terms(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i in (2, 5, 11))) for i in range(300)], "doc_id long, toxic int")
    seen = [i for i in (2, 5, 11) if not toxicity.crc_held_out(i)]
    clean = [i for i in range(20, 60) if not toxicity.crc_held_out(i)]
    copies = [(1000 + i, dict(rows)[i].upper()) for i in seen + clean]
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows + copies, "doc_id long, text string"), labels).collect()}
    assert seen and all(got[1000 + i].predicted == 1 and got[1000 + i].best_cosine > 0.999 for i in seen)
    assert all(got[1000 + i].predicted == 0 and got[1000 + i].n_near > 0 for i in clean)


def test_archives(spark):
    big = "x" * 3_000_000
    rows = [(1, "http://a/ b\n", "hello"), (2, None, "hello"), (3, "u", None), (4, "u", ""), (None, "u", "hello"), (5, "u", big), (6, "u", "a\r\n\r\nContent-Length: 3\r\n\r\n"), (6, "u", "z"), (6, "u", "z")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in got) == sorted([
        ("1", 5, "response", "None"), ("2", 5, "revisit", "1"), ("None", 5, "revisit", "1"), ("3", 0, "response", "None"), ("4", 0, "revisit", "3"),
        ("5", 3_000_000, "response", "None"), ("6", 26, "response", "None"), ("6", 1, "response", "None"), ("6", 1, "revisit", "6")])
    assert {r.payload_digest for r in got if r.payload_bytes == 0} == {"3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"}


def test_word_hashes_depend_on_the_word_only():
    a, b = Words([b"Alpha beta", b"x" * 3_000_000 + b" alpha"]), Words([b"beta", b"", b"  ALPHA"])
    assert a.hash[0] == a.hash[3] == b.hash[1] and a.hash[1] == b.hash[0]
    assert a.count.tolist() == [2, 2] and b.count.tolist() == [1, 0, 1]
    assert len(np.unique(mix(np.arange(1000, dtype=np.uint64)))) == 1000
