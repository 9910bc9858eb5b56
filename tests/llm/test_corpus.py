"""Sharding, mixing, packing, and the pipeline."""
import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from aerofield.llm import mixing, packing, sharding, tokens
from aerofield.llm.tokens import Words

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus(docs_of):
    draw = np.random.default_rng(11)
    rows = [(i, " ".join(["word"] * int(draw.integers(1, 400))) + f" {i % 150}.", "en", f"s{draw.integers(0, 5)}") for i in range(400)]
    rows += [(1000 + i, "the same text " * 20, "en", "hot") for i in range(200)]
    rows += [(2000, None, None, None), (2001, "", "en", None), (2002, "lone words", "en", None), (2003, None, "en", "void"), (7, rows[7][1], "en", rows[7][3])]
    return rows, docs_of(rows)


def test_shards(corpus):
    rows, docs = corpus
    got = sharding.query(docs).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert max(sizes) < 1.02 * min(sizes)
    text = {i: t or "" for i, t, *_ in rows}
    at = collections.defaultdict(set)
    for r in got:
        at[text[r.doc_id]].add(r.shard)
    whole = [t for t in at if "same text" not in t]  # that group is a third of all rows: more than a shard
    assert all(len(at[t]) == 1 for t in whole) and len(at["the same text " * 20]) > 1


def test_placement_fits_three_measures():
    draw = np.random.default_rng(12)
    items = draw.dirichlet(np.ones(3), 500) * draw.random((500, 1)) ** 2
    items /= items.sum(axis=0)
    at = sharding.place(items, 8)
    loads = np.array([items[at == k].sum(axis=0) for k in range(8)])
    assert abs(loads[:, 0] - 1 / 8).max() < 0.002 and abs(loads - 1 / 8).max() < 0.02


def test_shards_of_nothing(docs_of):
    assert sharding.query(docs_of([])).count() == 0


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    whole, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        left = whole - sum(target.values())
        level = left / max(sum(weight[s] for s in free), 1)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over


def test_mix(corpus):
    rows, docs = corpus
    size = lambda t: len((t or "").split())
    got = mixing.query(docs).collect()
    again = mixing.query(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    totals = collections.Counter()
    for _, t, _, s in rows:
        totals[s] += size(t)
    want = brute_targets(dict(totals))
    source = {i: s for i, _, _, s in rows}
    words, most = collections.Counter(), collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == totals[s] and r.target == pytest.approx(want[s]) and r.taken in (0, r.size, 2 * r.size)
        words[s] += r.taken
        most[s] = max(most[s], r.size)
    assert all(abs(words[s] - want[s]) <= most[s] for s in want)  # one draw of a repeated row stands for both
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert all(copies[r.doc_id] * r.size == r.taken * (2 if r.doc_id == 7 else 1) for r in got if r.size)


def test_mix_of_nothing(docs_of):
    assert mixing.query(docs_of([])).count() == 0
    assert mixing.mixed(docs_of([(1, None, "en", "a"), (2, "", "en", None)])).count() == 0


TRICKY = ["a <|endoftext|> b<|startoftext|>c It's we'll x ýz \x1c q\x1dz naïve ÀÉÎ Straße'S 12ab3 ΑΣ İstanbul <|EndOfText|> ...",
          "HELLO,world!? (ok)[no] don't... é ́x  wide gap 漢字かな ½ ²  ", "a" * 5000, "x.y,z;" * 300, "﻿​-‍"]


def encoder():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_words_give_the_library_ids(monkeypatch):
    words, whole = Words(public_tokenizers.path("word_bpe_49k.json"), most=40), encoder()
    monkeypatch.setattr(tokens, "GROUP_BYTES", 3000)
    monkeypatch.setattr(tokens, "GROUP_WORDS", 30)
    texts = [*TRICKY, "", None, *[" ".join(f"Num{i}, of{i % 7}." for i in range(n)) for n in (120, 400, 3)]]
    got = collections.defaultdict(list)
    for i, ids, _, _ in words.texts(None if t is None else t.encode() for t in texts):
        got[i] += ids.tolist()
    for i, t in enumerate(texts):
        assert got[i] == whole.encode(t or "", add_special_tokens=False).ids, i


def test_packing(docs_of, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(10, None), (11, ""), (None, "no id here."), (12, "long text. " * 9000), (13, "word " * 7000)]
    rows += [(20 + i, "some words of a document, and one more sentence. " * (i % 40)) for i in range(120)]
    got = packing.packed(docs_of(rows).coalesce(1)).collect()
    whole = encoder()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 0 if not at & (at - 1) else 4096 - at
    assert padding < 0.02 * sum(r.length for r in got)
    assert packing.packed(docs_of([])).count() == 0


def test_cuts_are_the_cheapest():
    draw = np.random.default_rng(13)
    for _ in range(60):
        points = np.concatenate([[0], np.cumsum(draw.integers(1, 9, 14))])
        costs = draw.integers(0, 6, 15)
        window = int(draw.integers(8, 20))
        best = {0: (0, [0])}
        for j in range(1, 15):
            best[j] = min((best[i][0] + window - int(points[j] - points[i]) + int(costs[j]), best[i][1] + [j])
                          for i in range(j) if points[j] - points[i] <= window)
        path = packing.cut_points(points, costs, window)
        assert points[-1] - points[path[-1]] < window and all(points[b] - points[a] <= window for a, b in zip(path, path[1:]))
        spent = sum(window - int(points[b] - points[a]) + int(costs[b]) for a, b in zip(path, path[1:]))
        assert spent == min(best[j][0] for j in range(15) if points[-1] - points[j] < window)


def test_every_operator_is_registered():
    names = set(contract.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_stages(spark, tables):
    """The pipeline is its stages in turn, and each does what its operator says."""
    docs, columns = tables["documents"], tables["documents"].columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name == "windows":
            ids = sum(len(encoder().encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.select("text").collect())
            assert out.agg(F.sum("length")).first()[0] == ids
            break
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        now = docs.count()
        if name == "secret_spans":
            assert now == before
            assert not docs.where("text rlike 'AKIA[A-Z0-9]{12}'").count()
        elif name != "source_mix":
            assert 0 < now <= before and docs.select("doc_id").distinct().count() == now
        before = now
    run = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, run.drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect())) == sorted(
        map(tuple, out.drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect()))


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None)], [(1, ""), (1, ""), (2, "x" * 200_000)]])
def test_pipeline_of_odd_tables(spark, docs_of, rows):
    docs = docs_of(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == 0
