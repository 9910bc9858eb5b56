"""Presence-mask search, merge rounds and cross-tokenizer groups against brute force."""
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from aerofield.llm import alignment, pieces, search

TERMS = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- search ----

def brute_search(docs, items, k):
    held = [(d, Counter(TERMS.findall((t or "").translate(A_Z)))) for d, t in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    n_docs, tokens = len(held), sum(n for _, _, n in held)
    out = []
    for item, text in items:
        own = dict.fromkeys(TERMS.findall((text or "").translate(A_Z)))
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c, _ in held) + 1))) for t in own}
        got = []
        for d, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // tokens
            got.append((-sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own), d is None, d))
        best = sorted(x for x in got if x[0] < 0)[:k]
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(best, 1)]
    return sorted(out, key=str)


def words_of(rng, n):
    return " ".join(rng.choice(["a", "b", "Cc", "dé", "e7", "日本", "x-y", "zz"]) for _ in range(n))


@pytest.mark.parametrize("block", [3, 8192])
def test_search_equals_brute_force(spark, docs_of, block):
    rng = random.Random(5)
    rows = [(i, words_of(rng, rng.randrange(0, 30))) for i in range(90)]
    rows += [(None, "a b zz"), (None, "a b zz"), (7, rows[7][1]), (200, None), (201, ""), (202, " .\n"), (-3, "a " * 900)]
    items = [(0, "A zz e7"), (1, "nowhere"), (2, None), (3, ""), (0, "A zz e7"), (4, words_of(rng, 40) + " dé DÉ"), (None, "b")]
    got = search.ranked(docs_of(rows).repartition(3), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, score int"), 5, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(rows, items, 5)


def test_search_of_many_terms_and_a_long_text(spark, docs_of):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.sample([f"t{j}" for j in range(200)], 60))) for i in range(120)]
    rows.append((500, "t1 t150 filler " * 200_000))  # some MB, read in blocks
    items = [(0, " ".join(f"t{j}" for j in range(200))), (1, "t1 t70 t150")]  # masks of several words
    got = search.ranked(docs_of(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(rows, items, 50)


def test_search_in_several_blocks_of_items(spark, docs_of, monkeypatch):
    monkeypatch.setattr(search, "ITEMS", 4)
    rows, items = [(i, f"w{i % 5} w{i % 3}") for i in range(30)], [(i, f"w{i % 6}") for i in range(11)]
    got = search.ranked(docs_of(rows), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(rows, items, 4)


def test_search_without_rows(spark, docs_of):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.ranked(docs_of([(1, "a")]).limit(0), items).collect() == []
    assert search.ranked(docs_of([(1, "a")]), items.limit(0)).collect() == []
    assert search.ranked(docs_of([(1, None), (2, "?")]), items).collect() == []


def test_masks_are_the_terms_held():
    block = search.Block(np.arange(5), np.full(5, 60), np.array([2, 0, 1, 2, 1]), np.array([3, 9, 9, 3, 9, 4]), np.array([1, 2, 3, 1, 1, 5]))
    masks, docs, bounds = block.masks(np.array([0, 2]))  # terms 3 and 9
    groups = {tuple(m): docs[a:b].tolist() for m, a, b in zip(masks.tolist(), bounds[:-1], bounds[1:])}
    assert groups == {(1, 1): [0, 3], (0, 1): [2]}
    assert block.most.tolist() == [1, 5, 3]


# ---- pieces ----

@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


ALPHABETS = ["ab", "aabc ", "  ab\n\t\r", "abcdefghijklmnopqrstuvwxyz ", "".join(map(chr, range(300))), "日本語中文▁ 😀́\x00�﻿", "<s>/0x41 ", "-=_*# \n"]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(ALPHABETS).flatmap(lambda a: st.lists(st.text(alphabet=a, max_size=120), max_size=4)))
def test_ids_and_texts_are_the_library_s(library, texts):
    coder = pieces.store(pieces.model_path())
    ids = [x.tolist() for x in coder.encode([pieces.blanked(t) for t in texts])]
    assert ids == [library.encode(t) for t in texts]
    assert [coder.vocabulary.decode(x) for x in ids] == [library.decode(x) for x in ids]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(3, 262), st.integers(0, 31_999)), max_size=12))
def test_any_ids_decode_as_the_library_does(library, ids):
    assert pieces.store(pieces.model_path()).vocabulary.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 30_000 + "x", "ab" * 20_000, "x " * 400_000, "日本" * 5_000, "\n" * 3_000])
def test_long_texts(library, text):
    store = pieces.store(pieces.model_path())
    (ids,) = store.encode([pieces.blanked(text)])
    assert ids.tolist() == library.encode(text)
    assert store.vocabulary.decode(ids) == library.decode(ids.tolist())


def test_a_full_store_is_emptied_without_effect(library):
    store = pieces.Store(pieces.store(pieces.model_path()).vocabulary, most=3)
    texts = [f"word{i} and again word{i % 3}" for i in range(40)]
    assert [x.tolist() for t in texts for x in store.encode([pieces.blanked(t)])] == [library.encode(t) for t in texts]


def test_piece_columns(spark, docs_of, library):
    rows = [(1, "Hello  world\n▁x"), (1, "Hello  world\n▁x"), (None, None), (2, ""), (3, "😀 \u0000")]
    out = pieces.decoded(pieces.encoded(docs_of(rows).withColumn("word", F.lit(1))))
    for r in out.collect():
        assert r["ids"] == library.encode(r["text"] or "") and r["decoded"] == library.decode(library.encode(r["text"] or ""))
    assert out.count() == 5 and "word" in out.columns
    assert pieces.query(docs_of(rows).limit(0)).collect() == []
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(d, len(i := library.encode(t or "")), digest(",".join(map(str, i))), digest(library.decode(i))) for d, t in rows]
    assert sorted(map(tuple, pieces.query(docs_of(rows)).collect()), key=str) == sorted(want, key=str)
    with pytest.raises(ValueError):
        pieces.encoded(docs_of(rows).withColumn("ids", F.lit(1)))


# ---- alignment ----

def brute_alignment(rows, library):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path(alignment.BYTES))
    coder.encode_special_tokens = True
    byte, names = alignment.printable(), {i: n for n, i in coder.get_vocab().items()}
    spell_b = lambda i: bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode()
    told, count = [], Counter()
    for doc, text in rows:
        a, b = (coder.encode(" " + text, add_special_tokens=False).ids, library.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [bytes(byte[c] for c in names[i]) for i in a], [spell_b(i) for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            told.append((doc, [], [], 0, [], ""))
            continue
        ends_a, ends_b = ([sum(map(len, x[:i + 1])) for i in range(len(x))] for x in (bytes_a, bytes_b))
        said, at, common = [], 0, sorted(set(ends_a) & set(ends_b))
        for end in common:
            inside = lambda ids, ends: ",".join(str(i) for i, e in zip(ids, ends) if at < e <= end)  # noqa: B023, E731
            said.append(f"{inside(a, ends_a)}|{inside(b, ends_b)}")
            at = end
        links = [(i, j) for i, e, x in zip(a, ends_a, bytes_a) for j, f, y in zip(b, ends_b, bytes_b) if e - len(x) < f and f - len(y) < e]
        count.update(links)
        told.append((doc, a, b, len(common), links, hashlib.sha256(";".join(said).encode()).hexdigest()))
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return sorted([(d, len(a), len(b), g, len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), h)
                   for d, a, b, g, ls, h in told], key=str)


@pytest.mark.parametrize("chunk", [40, 1 << 19])
def test_alignment_equals_brute_force(spark, docs_of, library, chunk, tables):
    rng = random.Random(3)
    alphabets = ["ab c.\n", "".join(map(chr, range(400))), "日本語中▁ 😀́　", "<|endoftext|> '`s", "a \t\r\n "]
    rows = [(r["doc_id"], r["text"][:600]) for r in tables["documents"].select("doc_id", "text").limit(40).collect()]
    rows += [(1000 + k, "".join(rng.choice(alphabets[k % 5]) for _ in range(rng.randrange(0, 60)))) for k in range(150)]
    rows += [(None, None), (7, ""), (7, "abc"), (7, "abc"), (8, "<|endoftext|> x"), (9, "a▁b"), (None, "x")]
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    made = alignment.aligned(docs_of(rows).repartition(3)).withColumn("groups_sha256", digest)
    assert sorted(map(tuple, alignment.linked(made, chunk=chunk).collect()), key=str) == brute_alignment(rows, library)
    if chunk > 40:
        assert sorted(map(tuple, alignment.query(docs_of(rows)).collect()), key=str) == brute_alignment(rows, library)


def test_a_task_aligns_and_chunks_in_one_python_worker(spark, docs_of, monkeypatch):
    plans, stored = [], alignment.materialized
    monkeypatch.setattr(alignment, "materialized", lambda df, label: (plans.append((label, df._jdf.queryExecution().toString())), stored(df, label))[1])
    rows = [(k, f"some words {k} \n of text") for k in range(30)] + [(None, None), (7, "")]
    got = alignment.query(docs_of(rows), 20)
    assert [plan.partition("== Physical Plan ==")[2].count("MapInArrow") for label, plan in plans if label == "chunks"] == [1]
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    parts = alignment.linked(alignment.aligned(docs_of(rows)).withColumn("groups_sha256", digest), chunk=20)
    assert got.schema == parts.schema and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, parts.collect()), key=str)


def test_a_long_text_is_aligned_as_its_units(spark, docs_of, library, monkeypatch):
    text = "The quick  brown fox's 日本 jumps;\nover it all. " * 40
    monkeypatch.setattr(pieces, "BLOCK", 64)
    one = alignment.Aligner(*[__import__("public_tokenizers").path(f) for f in (alignment.BYTES, pieces.MODEL)], most=5)
    (found,) = one.texts([text])
    (doc,) = brute_alignment([(1, text)], library)
    assert found[:4] == doc[1:5] and hashlib.sha256(found[4].encode()).hexdigest() == doc[7]


def test_alignment_without_rows_or_tokens(spark, docs_of):
    assert alignment.query(docs_of([(1, "a")]).limit(0)).collect() == []
    assert [tuple(r) for r in alignment.query(docs_of([(1, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
    with pytest.raises(ValueError):
        alignment.aligned(docs_of([(1, "a")]).withColumn("pairs", F.lit(1)))


def test_links_inside_a_group():
    ends_a, ends_b = np.array([2, 5, 6, 9]), np.array([3, 6, 7, 8, 9])
    cut_a, cut_b = alignment.groups(ends_a, ends_b)
    assert (cut_a.tolist(), cut_b.tolist()) == ([3, 4], [2, 5])
    i, j = alignment.links(ends_a, ends_b, cut_a, cut_b)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 2), (3, 3), (3, 4)]
