"""The ranked search, the nearest neighbours and the spelling variants against plain versions of their contracts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandlog.llm import inverted_index, lexical, queries, variants

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain_rank(docs, items, k=20):
    """docs, items: lists of (id, text)."""
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        own, scored = Counter(TERM.findall((text or "").translate(LOWER))), []
        for i, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in own.items() if c[t])
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def ranked(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(map(tuple, lexical.rank(d, spark.createDataFrame(items, "item_id long, text string"), **options).collect()))


def test_ranked_search_equals_plain(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    found = queries.op11_lexical(spark, data)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect())) == plain_rank(docs, items)


def test_ranked_search_of_odd_rows_ties_and_long_texts(spark, monkeypatch):
    texts = [None, "", "...", "a b c", "a b c", "A, b; c!", "É é a", "x " * 50_000 + "rare", "b " * 3, "あ z9", " " * 1_000_000, "a" * 1_000_000, "rare rare a"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "a b c"), (None, "a b rare")] + [(1000 + i, "a b common words here") for i in range(60)]
    items = [(0, "a b"), (0, "rare x"), (1, None), (2, ""), (3, "a a a rare"), (3, "a a a rare"), (4, "あ Z9 É"), (5, "nowhere"), (6, "common " + "a" * 1_000_000)]
    expected = plain_rank(docs, items)
    assert ranked(spark, docs, items) == expected
    monkeypatch.setattr(lexical, "ITEMS", 2)  # several blocks
    assert ranked(spark, docs, items) == expected
    assert ranked(spark, docs, []) == [] and ranked(spark, [], items) == [] and ranked(spark, [(1, "...")], items) == []


@pytest.mark.parametrize("seed", range(2))
def test_search_closes_items_before_all_is_read(spark, seed, monkeypatch):
    """Random collections with many bands: documents leave, items close, and nothing changes in the result."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    p = 1 / np.arange(1, 301) ** 1.1
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 120), p=p / p.sum()))) for i in range(700)]
    items = [(i, " ".join(rng.choice(words[5:], 6))) for i in range(12)]
    monkeypatch.setattr(lexical, "BANDS", (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 1.0))
    assert ranked(spark, docs, items, k=5) == plain_rank(docs, items, 5)


def plain_nearest(ids, x, k=20, every=20):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (x[q] * x).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(r + 1, int(ids[i]), float(s[i])) for r, i in enumerate(order)]
    return out


def _found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def _recall(found, exact):
    return sum(len({v for _, v, _ in found.get(q, [])} & {v for _, v, _ in rows}) for q, rows in exact.items()) / sum(map(len, exact.values()))


def test_neighbours_meet_their_recall_and_keep_exact_scores(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    exact, found = plain_nearest(ids, x), _found(queries.op12_neighbours(spark, folder))
    assert set(found) == set(exact) and _recall(found, exact) >= 0.9
    score = {(q, v): s for q, near in plain_nearest(ids, x, k=len(ids)).items() for _, v, s in near}
    for q, near in found.items():
        assert [r for r, _, _ in near] == list(range(1, 21))
        assert all(abs(s - score[q, v]) < 1e-12 for _, v, s in near)
        assert near == sorted(near, key=lambda r: (-r[2], r[1]))


def test_clustered_vectors_are_found_in_few_cells(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(40, 16))
    x = middle[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    exact = plain_nearest(np.arange(4000), x)
    assert _recall(_found(inverted_index.search(frame, shard=300)), exact) >= 0.9
    usable = inverted_index._usable(frame, "embedding", "vec_id", 16)
    *_, reach = inverted_index.build(usable, usable.filter("vec_id % 20 = 0"), 16, 4000, 20, 0.95, 300)
    assert reach < 800


def test_odd_vectors_and_hot_ones(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100)]  # a hot cell, split over shards; ties to smaller ids
    rows += [(100, [0.0, 0.0, 0.0]), (120, None), (140, [1.0, nan, 1.0]), (160, [1.0, inf, 1.0]), (180, [1.0, None, 1.0]), (200, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (300, [-1.0, 0.5, 0.25]), (20, [9.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    found = _found(inverted_index.search(frame, recall=1.0, shard=16))
    assert set(found) == {0, 20, 40, 60, 80, 300}
    assert [v for _, v, _ in found[40]] == [0, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18]  # row (20, [9, 0, 0]) is behind
    assert [v for _, v, _ in found[20]][:2] == [0, 1] and 20 not in [v for _, v, _ in found[20]]
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert _found(inverted_index.search(two)) == {0: [(1, 1, 2.0)]}
    assert inverted_index.search(frame.limit(0)).count() == 0 and inverted_index.search(frame.filter("vec_id = 100")).count() == 0


def plain_variants(docs, ratio=5):
    n = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}
    around, out, forms = {}, [], {}
    for w in n:
        for i in range(len(w)):
            around.setdefault((i, w[:i] + w[i + 1 :], len(w)), []).append(w)
    near = {w: set() for w in n}
    for (_, _, _), group in around.items():
        for a in group:
            near[a] |= set(group) - {a}
    for w in n:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            if short in n:
                near[w].add(short)
                near[short].add(w)
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= ratio * n[w] else None
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n[w], len(near[w]), n[forms[w]] if forms[w] else None))
    return sorted(out, key=repr)


def _variants(frame, **options):
    found = variants.variants(frame, **options)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_variants_equal_plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = plain_variants([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert len(expected) > 1000 and any(r[1] for r in expected)
    assert _variants(docs) == expected
    assert _variants(docs, group=1) == expected  # groups of more than one word take the way of large groups


def test_variants_of_odd_texts(spark):
    far = ["abcdef", "abcdeg", "abcdeé", "abcdefg", "bbcdef", "ABCDEF", "Àbcdef", "àbcdef", "straßen", "strassen", "strasen", "ĀabcdefŒabcdef", "xy" * 1000]
    docs = [(i, None if i % 7 == 6 else " ".join(far[: 3 + i % 11]) * (1 + 30 * (i % 3 == 0))) for i in range(60)] + [(None, "abcdef strassen 1abcdef2"), (3, "abcdef"), (3, "abcdef"), (4, ""), (5, " " * 1_000_000), (6, "longer" * 3 + "\n" + "x" * 1_000_000)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n string")
    assert _variants(frame) == plain_variants(docs)
    assert _variants(frame.limit(0)) == []


def test_chains_of_forms_end_at_their_root(spark):
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]
    docs = [(1, " ".join(" ".join([w] * (5**i * 5)) for i, w in enumerate(words)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r[0]: r[2] for r in _variants(frame)}
    assert _variants(frame) == plain_variants(docs) and set(found.values()) == {"aabbbb"}
