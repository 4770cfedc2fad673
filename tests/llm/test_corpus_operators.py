"""Phrases, repeated passages and lexical search against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import lexical, phrases, suffixes

DOCS = "doc_id bigint, text string, lang string, h bigint, score bigint, body string, rank int, block bigint"
ODD = [
    (1, None, "en", 1, None, "x", 1, 1), (2, "", None, 1, 2, None, 1, 1), (3, "one", "en", 1, 2, "x", None, 1),
    (3, "one", "en", 1, 2, "x", 1, 1), (None, "one two", "fr", None, 2, "x", 1, None), (4, "One  TWO\n\n three, ", "en", 1, 2, "x", 1, 1),
    (5, "long " * 30_000 + "end", None, 1, 2, "x", 1, 1), (6, " \t\n", "en", 1, 2, "x", 1, 1), (None, None, None, None, None, None, None, None),
    (7, "é ÀÉ x1 ́y", "und", 1, 2, "x", 1, 1), (8, "one two three one two three. one two", "\t\n ü", 1, 2, "x", 1, 1),
]


def frame(spark, rows, schema="doc_id bigint, text string, lang string"):
    return spark.createDataFrame(rows, schema)


def shuffled_texts(seed, count, words=40, vocabulary=12):
    pick = random.Random(seed)
    names = ["".join(pick.choice("abcdé") for _ in range(1 + at % 4)) for at in range(vocabulary)]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!"]
    out = []
    for at in range(count):
        text = "".join(pick.choice(names) + pick.choice(marks) for _ in range(pick.randrange(words)))
        out.append((at, text.upper() if at % 7 == 0 else text, pick.choice(["en", "fr", None])))
    return out


# 11


def brute_phrases(rows, top, least):
    f, n = defaultdict(Counter), Counter()
    for row in rows:
        lang = "und" if row[2] is None else row[2]
        text = re.sub("[A-Z]", lambda m: m[0].lower(), row[1] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                for at in range(len(words) - m + 1):
                    f[lang][tuple(words[at : at + m])] += 1
    out = []
    for lang, counts in f.items():
        known = [(p, a) for p, a in counts.items() if len(p) > 1 and a >= least]
        held = defaultdict(int)
        for p, a in known:
            for m in range(2, len(p)):
                for at in range(len(p) - m + 1):
                    held[p[at : at + m]] = max(held[p[at : at + m]], a)
        scored = []
        for p, a in known:
            if held[p] >= a:
                continue
            cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-cut[0], -a, " ".join(p).encode(), counts[p[: cut[1]]], counts[p[cut[1] :]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("top", "least", "block"), [(2000, 3, 1 << 20), (5, 2, 50), (1, 4, 7)])
def test_phrases_equal_brute_force(spark, top, least, block):
    rows = shuffled_texts(top, 150)
    found = phrases.best(frame(spark, rows).repartition(3), top, least, block)
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, top, least)


def test_phrases_inside_longer_ones_go(spark):
    rows = [(at, "red green blue. " + ("red green " if at % 2 else "x ") + f"w{at}", "en") for at in range(10)]
    found = phrases.best(frame(spark, rows), 10, 5)
    assert {row["phrase"] for row in found.collect()} == {"red green blue", "red green"}
    assert brute_phrases(rows, 10, 5) == sorted(map(tuple, found.collect()))


def test_phrases_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, DOCS)
    rows = [(row[0], row[1], row[2]) for row in ODD]
    assert sorted(map(tuple, phrases.best(odd, 100, 2).collect())) == brute_phrases(rows, 100, 2)
    assert phrases.best(odd.limit(0)).collect() == []
    assert phrases.best(odd, least=10**6).collect() == []


def test_phrase_counts_may_pass_64_bits(spark):
    """Scores are quotients of products that no 64-bit number holds."""
    corpus = phrases.Corpus(frame(spark, [(1, "a b " * 50, "en")]), 10)
    corpus.n[:] = 10**13
    corpus.grow(np.array([10**9]))
    found = {tuple(row["ids"]): row for row in corpus.scored().collect()}
    for row in found.values():
        assert row["score"] == 1000 * row["a"] * 10**13 // (row["l"] * row["r"])


# 12


def brute_removed(rows, least, keep):
    seen = defaultdict(list)
    bodies = [(row[1] or "").encode() for row in rows]
    order = sorted(range(len(rows)), key=lambda at: (rows[at][0] is not None, rows[at][0] or 0))
    for at in order:
        for place in range(len(bodies[at]) - least + 1):
            seen[bodies[at][place : place + least]].append((at, place))
    gone = [np.zeros(len(body), dtype=bool) for body in bodies]
    for places in seen.values():
        for at, place in places[1:] if keep == "first" else places if len(places) > 1 else []:
            gone[at][place : place + least] = True
    out = []
    for row, body, cut in zip(rows, bodies, gone, strict=True):
        edge = np.diff(np.concatenate([[0], cut.astype(int), [0]]))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        out.append((row[0], len(body), spans, np.frombuffer(body, np.uint8)[~cut].tobytes()))
    return sorted(out, key=str)


def removed(docs, *args, **held):
    rows = suffixes.removed(docs, *args, **held).collect()
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in rows), key=str)


def passages_shared(seed, count):
    pick = random.Random(seed)

    def some(size):
        return "".join(pick.choice("abcdefghé ") for _ in range(size))

    common, other = some(150), some(400)
    out = []
    for at in range(count):
        text = some(pick.randrange(300))
        if at % 3:
            text += common + some(pick.randrange(80))
        if at % 4 == 0:
            text += other[pick.randrange(100) : pick.randrange(250, 400)]
        out.append((at, text, "en"))
    return [*out, (count, out[1][1], "en"), (count + 1, "ab" * 300, "en"), (count + 2, other + common + other, "en")]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("held", [{}, {"hot_chunk": 1, "hot_bucket": 1}, {"piece": 97, "chunk_bytes": 500, "hot_chunk": 3}, {"hot_bucket": 4}])
def test_removed_passages_equal_brute_force(spark, keep, held):
    rows = passages_shared(5, 60)
    docs = frame(spark, rows).repartition(3, "doc_id")
    assert removed(docs, 80, keep, **held) == brute_removed(rows, 80, keep)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_starts_of_a_hot_anchor_are_told_in_runs(spark, keep):
    """A passage that many documents share is a few rows of each, not one for each of its starts."""
    pick = random.Random(8)

    def some(size):
        return "".join(pick.choice("abcdefghé ") for _ in range(size))

    common = some(500)
    rows = [(at if at else None, some(150) + common + some(150), "en") for at in range(60)]
    docs = frame(spark, rows).repartition(3, "doc_id")
    found = suffixes.passages(docs, 80, keep, hot_chunk=1, hot_bucket=1).collect()
    starts = len(common.encode()) - 80 + 1
    assert len({(r["doc_id"], at) for r in found for at in range(r["at"], r["at"] + r["n"])}) >= 60 * starts
    assert len(found) < 60 * starts // 10
    assert removed(docs, 80, keep, hot_chunk=1, hot_bucket=1) == brute_removed(rows, 80, keep)


def test_factor_arrays_equal_brute_force():
    pick = np.random.default_rng(2)
    for _ in range(30):
        data, depth = pick.integers(97, 99, 60).astype(np.uint8), 8 + int(pick.integers(0, 20))
        raw, starts = data.tobytes(), np.arange(60 - depth + 1)
        order, shared = suffixes.suffix_order(data, starts, depth)
        assert [raw[at : at + depth] for at in order] == sorted(raw[at : at + depth] for at in starts)
        for at, length, source in zip(order, *suffixes.previous_factors(order, shared), strict=True):
            before = [other for other in range(at) if raw[other : other + depth] == raw[at : at + depth]]
            assert (length == depth) == bool(before) and (source in before or not before)

        def common(a, b):
            return next((n for n in range(60) if a + n == 60 or b + n == 60 or raw[a + n] != raw[b + n]), 60)

        every = np.array(sorted(range(60), key=lambda at: raw[at:]))
        shared = np.array([0, *[common(every[at - 1], every[at]) for at in range(1, 60)]])
        for at, length, source in zip(every, *suffixes.previous_factors(every, shared), strict=True):
            assert length == max([common(at, other) for other in range(at)], default=0)
            assert source == -1 if not length else source < at and common(at, source) == length


def test_removed_passages_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, DOCS)
    assert removed(odd) == brute_removed([(row[0], row[1]) for row in ODD], 200, "none")
    assert removed(odd.limit(0)) == []
    twice = frame(spark, [(1, "x" + "y" * 20 + "z" * 190, "en")] * 2 + [(None, "ü" * 120, "en")] * 2 + [(2, "short", "en")])
    found = suffixes.removed(twice)
    digests = sorted(map(tuple, found.select(*suffixes.digest_columns(found)).collect()), key=str)
    empty, rest = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"short").hexdigest()
    assert digests == [(1, 211, 211, 1, empty)] * 2 + [(2, 5, 0, 0, rest)] + [(None, 240, 240, 1, empty)] * 2
    with pytest.raises(ValueError):
        suffixes.removed(twice, 10)


# 13


def brute_search(rows, items, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in pattern.findall(text or "")]

    docs = [(row[0], Counter(terms(row[1]))) for row in rows]
    docs = [(doc_id, tf, tf.total()) for doc_id, tf in docs if tf]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(term for _, tf, _ in docs for term in tf)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, tf, n in docs:
            m = 100 - 25 + 25 * n * n_docs // total
            score = 0
            for term in terms(text):
                if tf[term]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += weight * (1_000_000_000 * tf[term] // (1000 * tf[term] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item_id, rank, None if none else doc_id, -score))
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "rows_a_shard", "query_rows"), [(20, 1 << 16, 2048), (3, 10, 4), (1, 1, 2048)])
def test_search_equals_brute_force(spark, k, rows_a_shard, query_rows):
    rows = shuffled_texts(k, 200, 60, 60)
    items = [(at, text) for at, text, _ in shuffled_texts(99, 20, 12, 60)] + [(100, None), (101, "absent"), (102, rows[5][1] * 3)]
    index = lexical.build(frame(spark, rows).repartition(3), shard_rows=rows_a_shard)
    found = lexical.search(index, spark.createDataFrame(items, "item_id bigint, text string"), k, query_rows)
    assert sorted(map(tuple, found.collect()), key=str) == brute_search(rows, items, k)


def test_blocks_are_rejected_before_they_are_unpacked():
    """A list that cannot lift a document among the best stays packed, and the hits stay those of brute force."""
    pick = random.Random(1)
    rows = [(at, ("the " * pick.randrange(1, 9)) + (f"rare{at // 300 % 3} " if at % 300 == 0 else "") + "pad " * pick.randrange(30), None) for at in range(3000)]
    known, codes = lexical.Numbers(), []
    for row in rows:
        terms = lexical.terms_of(row[1].encode())
        codes.append(np.array([known[term] for term in terms]))
    names = [part.split()[0] for part in lexical.INDEX.split(", ")]
    row = dict(zip(names, lexical.shard_row(0, known, codes, [row[0] for row in rows]), strict=True))
    stats = lexical.Stats(len(rows), sum(map(len, codes)))
    shard = lexical.Shard(row, stats)
    df = Counter(code for own in codes for code in set(own.tolist()))
    query = {term: stats.weight(df[known[term]]) for term in (b"the", b"rare1", b"rare2")}
    assert query[b"the"] > 0 or df[known[b"the"]] == 3000
    query[b"the"] = max(query[b"the"], 3)
    heap = lexical.Heap(2)
    shard.search(query, heap, window=256)
    assert shard.unpacked < sum(len(lexical.Postings(shard, known[term], 1).last) for term in query) / 2
    wanted = []
    for doc_id, own in enumerate(codes):
        tf = Counter(own.tolist())
        score = sum(w * int(stats.impact(np.array([tf[known[t]]]), np.array([len(own)]))[0]) for t, w in query.items() if tf[known[t]])
        wanted.append((-score, doc_id))
    assert list(zip((-heap.score).tolist(), heap.ids.tolist(), strict=True)) == sorted(wanted)[:2]


def test_search_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, DOCS)
    items = [(1, "ONE two"), (1, "ONE two"), (None, "end three"), (2, ""), (3, None), (4, "x1 é")]
    frame_ = spark.createDataFrame([(*item, 5) for item in items], "item_id bigint, text string, doc_id int")
    wanted = brute_search([(row[0], row[1]) for row in ODD], list(dict.fromkeys(items)), 20)
    assert sorted(map(tuple, lexical.search(lexical.build(odd), frame_).collect()), key=str) == wanted
    assert lexical.search(lexical.build(odd.limit(0)), frame_).collect() == []
    assert lexical.search(lexical.build(odd), frame_.where(F.lit(False))).collect() == []
    assert lexical.search(lexical.build(odd), frame_.where("text = ''")).collect() == []
