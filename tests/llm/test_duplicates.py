"""Near-duplicates of texts and vectors against brute force."""
import math

import numpy as np
import pytest
import xxhash

from aerofield.llm import embeddings, simhash
from aerofield.llm.components import components
from aerofield.session import materialized


def joined_ids(ids, linked):
    """Smallest id reachable for each position."""
    comp = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in linked[i]:
                if comp[j] != comp[i]:
                    a, b = sorted((comp[i], comp[j]))
                    comp = [a if c == b else c for c in comp]
                    changed = True
    return [min((ids[j] for j in range(len(ids)) if comp[j] == comp[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    draw = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    place = {n: i for i, n in enumerate(nodes)}
    near = [[] for _ in nodes]
    for a, b in edges:
        if a != b:
            near[place[a]].append(place[b])
    assert got == dict(zip(nodes, joined_ids(nodes, near)))


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d e f g a b c d", "x" * 50 + " y" * 300, "Ä b c É\x1cf g"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) & (1 << 64) - 1 == brute_fingerprint(text)


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 37}x{i % 11}" for i in range(3000))
    whole = simhash.fingerprint(text.encode())
    real = simhash.word_blocks
    monkeypatch.setattr(simhash, "word_blocks", lambda data: real(data, size=100))
    assert simhash.fingerprint(text.encode()) == whole


def test_chains_find_every_pair():
    draw = np.random.default_rng(2)
    segs = simhash.segments(4)
    for _ in range(400):
        flips = draw.choice(64, draw.integers(0, 8), replace=False)
        x = np.array([sum(1 << int(b) for b in flips)], np.uint64)
        found = any(len(simhash.within(x, s, segs)) for s in range(len(segs)))
        assert found == (len(flips) <= 4)


@pytest.fixture(scope="module")
def near(docs_of):
    draw = np.random.default_rng(3)
    rows, n = [], 0
    for g in range(25):
        base = [f"w{x}" for x in draw.integers(0, 5000, 300)]
        for _ in range(int(draw.integers(1, 5))):
            words = list(base)
            for at in draw.integers(0, 300, draw.integers(0, 4)):
                words[at] = f"v{draw.integers(0, 99)}"
            rows.append((1000 - n, " ".join(words)))
            n += 1
    rows += [(3, None), (2, ""), (5, "short"), (6, "Short"), (6, "Short"), (None, rows[0][1]), (None, "lonely words stand here now")]
    return rows, docs_of(rows)


def test_simhash_groups(near):
    rows, docs = near
    prints = [brute_fingerprint(t) for _, t in rows]
    ids = [i for i, _ in rows]
    want = joined_ids(ids, [[j for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4] for i in range(len(rows))])
    got = simhash.query(docs).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == sorted(
        ((i, f"{p:016x}", c) for i, p, c in zip(ids, prints, want)), key=repr)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    groups = {c for c in want if c is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(groups)


def test_simhash_without_rows(docs_of):
    assert simhash.query(docs_of([])).count() == 0
    assert simhash.deduplicated(docs_of([])).count() == 0


def vectors(spark):
    draw = np.random.default_rng(4)
    rows = []
    for g in range(30):
        base = draw.standard_normal(16)
        for _ in range(int(draw.integers(1, 6))):
            rows.append((len(rows) + 10, [float(x) for x in base + draw.standard_normal(16) * 0.08], g))
    hub = draw.standard_normal(16)
    rows += [(len(rows) + 10, [float(x) for x in hub], 1) for _ in range(40)]
    rows += [(2, None, 0), (3, [], 0), (4, [0.0] * 16, 0), (5, [math.nan] + [1.0] * 15, 0), (6, [math.inf] + [1.0] * 15, 0),
             (7, [None] + [1.0] * 15, 0), (8, [1.0, 2.0], 0), (9, [2.0, 4.0], 0), (1, [1e300, 2e300], 0), (None, [3.0, 6.0], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("block", [1024, 8])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows, frame = vectors(spark)

    def usable(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def close(a, b):
        if not (usable(a) and usable(b)) or len(a) != len(b):
            return False
        a, b = (np.array(x) / max(map(abs, x)) for x in (a, b))
        return a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.9

    linked = [[j for j in range(len(rows)) if j != i and close(rows[i][1], rows[j][1])] for i in range(len(rows))]
    ids = [r[0] for r in rows]
    comp = joined_ids(ids, linked)
    got = embeddings.linked(frame).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == sorted(
        ((i, len(near), c, i == c) for i, near, c in zip(ids, linked, comp)), key=repr)


def test_embeddings_without_rows(spark):
    assert embeddings.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tables_follow_the_threshold():
    k, tables = embeddings.shape(10 ** 6, 0.9)
    hit = embeddings.same_cell(math.sqrt(0.2)) ** k
    assert (1 - hit) ** tables <= embeddings.MISSED
    assert embeddings.shape(0, 0.9)[0] == 1


def test_written_tables_are_read_back(spark):
    assert materialized(spark.range(5), "five").count() == 5
