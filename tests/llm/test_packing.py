"""Packing of tables in an unlucky order: what one chunk leaves open, another fills."""

import random

import pytest

from strandlog.llm import packing, token_counts, tokens


def test_open_bins_of_one_chunk_are_filled_by_another(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 4_000)
    sizes = [600] * 4_000 + [400] * 4_000
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing._PIECES).coalesce(1)
    rows = packing.pack_pieces(pieces).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(sizes)))
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= packing.LENGTH and len(ends) == 4_000


def test_best_fit_by_counts_is_best_fit():
    for seed in range(60):
        rng = random.Random(seed)
        length = rng.choice([7, 40, 1024])
        sizes = [rng.randint(1, length - 1) for _ in range(rng.choice([1, 30, 700]))]
        counts = {n: sizes.count(n) for n in set(sizes)}
        plan, bins = packing.best_fit_counts(counts, length), {}
        for row, following in zip(plan, [*plan[1:], None]):
            size, number, at, k, offset = row
            end = following[1] if following and following[0] == size else counts[size]
            for i in range(end - number):
                bins.setdefault(at + i // k, []).append((offset + i % k * size, size))
        for b in bins.values():
            b.sort()
            assert all(x + n == y for (x, n), (y, _) in zip(b, [*b[1:], (sum(b[-1]), 0)])) and sum(n for _, n in b) <= length
        assert sorted(n for b in bins.values() for _, n in b) == sorted(sizes)
        assert len(bins) == len(packing.best_fit(sizes, length))


def _in_bins(rows, length=packing.LENGTH):
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= length
    return len(ends)


@pytest.mark.parametrize("order", ["random", "by length"])
def test_the_tree_comes_near_one_global_best_fit(spark, monkeypatch, order):
    """At several sizes of chunks, with tables in random order and sorted by length: within 1 % of best fit over all."""
    rng = random.Random(9)
    sizes = [min(1023, int(rng.paretovariate(0.8) * 40)) if i % 3 else rng.randint(1, 1023) for i in range(12_000)]
    sizes = sorted(sizes) if order == "by length" else sizes
    whole = len(packing.best_fit(sizes, packing.LENGTH))
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing._PIECES)
    for chunk in (300, 1_500, 6_000):
        monkeypatch.setattr(packing, "CHUNK", chunk)
        rows = packing.pack_pieces(pieces).collect()
        assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(sizes))
        assert _in_bins(rows) <= 1.01 * whole


def test_underfull_bins_go_up_as_items(spark, monkeypatch):
    """Bins of one partition meet those of others in the rounds above, before anything is opened again."""
    monkeypatch.setattr(packing, "CHUNK", 50)
    levels, fitted = [], packing._fitted
    monkeypatch.setattr(packing, "_fitted", lambda items, length: levels.append(items) or fitted(items, length))
    pieces = spark.createDataFrame([(i, 0, 0, 1 + 37 * i % 500, 0) for i in range(900)], packing._PIECES)
    packing.pack_pieces(pieces).collect()
    assert len(levels) >= 3
    counts = [x.count() for x in levels]
    assert counts == sorted(counts, reverse=True) and max(x for x in levels[1].selectExpr("size(members)").toPandas().iloc[:, 0]) > 1


def test_long_runs_of_white_space_and_of_letters(spark, monkeypatch):
    """Texts with one run of a million and more characters, through the encoder and the two operators that use it."""
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    encode = tokens.encoder(tokens.vocabulary_path(packing.VOCABULARY)).encode
    monkeypatch.setattr(tokens, "LONG_BLANK", 5)
    monkeypatch.setattr(tokens, "_BLANK", tokens.re.compile(tokens._BLANK.pattern.replace("50000", "5")))
    for text in (" " * 9, "a" + "\n" * 7 + "b", "x \t\n\r\u2003\x85 y", "ab" + " " * 6 + "<|endoftext|>" + " " * 6, "." + "\x1c" * 8 + " z", " " * 5 + "\x1f" * 5, "1" + " " * 5 + "2" + "\xa0" * 9 + "é'll"):
        assert list(encode(text)) == bpe.encode(text, add_special_tokens=False).ids, text
    monkeypatch.undo()
    longest = [" " * 1_000_000, "\n" * 1_000_000 + "x", "a" * 1_000_000, "7" * 1_000_000, "x" + " \t" * 600_000 + "y", " " * 10_000_000]
    for text in longest[:5]:
        assert list(encode(text)) == bpe.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(i, t, "s", "l") for i, t in enumerate(longest)], "doc_id long, text string, source string, lang string")
    sizes = {i: 1 + len(encode(t)) for i, t in enumerate(longest)}
    found = {r.doc_id: r.n for r in packing.pack(docs).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert found == sizes
    assert token_counts.digest(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() > 0
