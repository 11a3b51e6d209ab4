import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import simhash

EDGE_DOCS = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "one"), (9004, "one"), (None, "one two"), (None, None), (9005, "ünder Ärger x" * 3000)]
ONE_WORD = {"shingle": 1, "bits": 128, "distinct": True}


def docs_of(spark, rows):
    """With extra columns whose names clash with those that operators make."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.withColumns({"fp": F.lit("x"), "id": F.lit(2), "row": F.lit(3), "key": F.lit(3), "rank": F.lit(0), "w0": F.lit(None).cast("string")})


def tokens(text):
    return (text or "").encode().lower().split()


def slices(words, k):
    return [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def contract_fingerprint(words):
    """Bit by bit, from the shingles' XXH64."""
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in slices(words, 4)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def whole(fp):
    return sum(int(w) << 64 * i for i, w in enumerate(fp))


def components(n, linked):
    up = list(range(n))
    for i in range(n):
        for j in range(i):
            if up[i] != up[j] and linked(i, j):
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = [new if u == old else u for u in up]
    return up


def least_ids(up, ids):
    return [min((ids[k] for k in range(len(ids)) if up[k] == u and ids[k] is not None), default=None) for u in up]


def near(fps, distance):
    return lambda i, j: (fps[i] ^ fps[j]).bit_count() <= distance


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["Foo,", "baß", "x.y"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(120)]
    return rows + [(200 + i, rows[i][1] + " tail") for i in range(40)] + [(300, rows[0][1])]


@pytest.mark.parametrize("distance", [4, 12])
def test_classes(spark, corpus, distance):
    rows = corpus + EDGE_DOCS
    ids, fps = [i for i, _ in rows], [contract_fingerprint(tokens(t)) for _, t in rows]
    got = sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in simhash.classes(docs_of(spark, rows), simhash.Params(distance=distance)).collect())
    want = least_ids(components(len(rows), near(fps, distance)), ids)
    assert got == sorted((str(i), f, str(c)) for i, f, c in zip(ids, fps, want))
    assert simhash.classes(docs_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("block,samples", [(2048, 8), (8, 1)])
@pytest.mark.parametrize("kind", [{}, {"bits": 128, "distance": 15}])
def test_no_link_is_lost_in_dense_and_split_groups(spark, monkeypatch, block, samples, kind):
    """Dense groups around a few centres; the star links that join them first are thinned out too."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SAMPLES", samples)
    own = simhash.Params(**kind)
    rng, fps = np.random.default_rng(2), set()
    for size in (60, 25, 25, 1, 1):
        base = int.from_bytes(rng.bytes(own.bits // 8), "little")
        fps |= {base ^ sum(1 << int(b) for b in rng.choice(own.bits, rng.integers(0, own.distance), replace=False)) for _ in range(size)}
    fps = sorted(fps)
    signed = lambda x: int(np.uint64(x % 2**64).view(np.int64))
    frame = spark.createDataFrame([(n, *(signed(f >> 64 * k) for k in range(own.bits // 64))) for n, f in enumerate(fps)], ", ".join(["id long", *(f"{w} long" for w in own.words)]))
    edges = [tuple(r) for r in simhash.links(frame, own).collect()]
    assert all(near(fps, own.distance)(a, b) for a, b in edges)
    linked = {*edges, *((b, a) for a, b in edges)}
    assert components(len(fps), lambda i, j: (i, j) in linked) == components(len(fps), near(fps, own.distance))
    assert samples == 1 or len(edges) < 8 * len(fps)


def near_copies(rng, groups, changes, n_words=100):
    rows = []
    for i in range(groups):
        words = [f"w{k}" for k in rng.integers(0, 3000, n_words)]
        for j, changed in enumerate(changes):
            own = list(words)
            for at in rng.choice(n_words, changed, replace=False):
                own[at] = f"x{i}_{j}_{at}"
            rows.append((100 * i + j, " ".join(own)))
    return rows


@pytest.mark.parametrize("block,minima", [(1024, 4), (7, 1)])
@pytest.mark.parametrize("kind", [{**ONE_WORD, "distance": 15}])
def test_links_are_verified_by_similarity(spark, monkeypatch, block, minima, kind):
    monkeypatch.setattr(simhash, "TEXT_BLOCK", block)
    monkeypatch.setattr(simhash, "MINIMA", minima)
    rng = np.random.default_rng(9)
    rows = near_copies(rng, 12, (0, 1, 2, 3, 3, 3)) + near_copies(rng, 1, (0, *(2, 3, 4, 5) * 8))[:33] + [(9000, None), (9001, ""), (9002, "one"), (9003, "ONE ")]
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    texts, own = [tokens(t) for _, t in rows], simhash.Params(similarity=0.8, **kind)
    fps, sets = [whole(simhash.fingerprint(w, own)) for w in texts], [set(slices(w, 5)) for w in texts]
    by_bits = components(len(rows), near(fps, own.distance))
    alike = lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    up = components(len(rows), lambda i, j: by_bits[i] == by_bits[j] and alike(i, j))
    assert len(set(by_bits)) < len(set(up)) < len(rows) - 10
    want = least_ids(up, [i for i, _ in rows])
    got = {r.doc_id: r.component_id for r in simhash.classes(docs_of(spark, rows), own).collect()}
    assert got == {i: c for (i, _), c in zip(rows, want)}
    assert sorted(r.doc_id for r in simhash.keep_first(docs_of(spark, rows), own).collect()) == sorted(set(want))


def test_recall_of_one_word_fingerprints(spark):
    """Of pairs with similarities from 0.8 to 0.92, nine in ten link, and none of others."""
    rng, rows = np.random.default_rng(4), []
    for i in range(300):
        words = [f"w{k}" for k in rng.zipf(1.3, 300) % 5000]
        other = list(words)
        for at in rng.choice(300, 3 + i % 4, replace=False):
            other[at] = f"x{i}_{at}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets = [set(slices(tokens(t), 5)) for _, t in rows]
    true = {2 * i for i in range(300) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1])}
    got = {r.doc_id: r.component_id for r in simhash.classes(docs_of(spark, rows), simhash.Params(distance=15, similarity=0.8, **ONE_WORD)).collect()}
    found = {i for i in true if got[i + 1] == i}
    assert len(true) > 100 and len(found) >= 0.9 * len(true)
    assert all(c in (i, i - i % 2) for i, c in got.items())


def test_keep_first_takes_one_row_of_each_class(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(7, text), (7, "other words here " * 9), (3, text.upper()), (3, text), (3, text), (None, text), (None, "alone " * 8), (None, "alone " * 8), (None, None), (2, "")]
    own = simhash.Params(distance=15, similarity=0.8, **ONE_WORD)
    kept = sorted((str(r.doc_id), (r.text or "").lower().split()[:1]) for r in simhash.keep_first(docs_of(spark, rows), own).collect())
    assert kept == sorted([("7", ["other"]), ("3", ["w0"]), ("None", ["alone"]), ("2", [])])
    assert simhash.keep_first(docs_of(spark, rows).limit(0), own).count() == 0


def test_pigeonhole_allocation():
    rng = np.random.default_rng(0)
    for bits, distance in ((64, 4), (64, 8), (128, 15)):
        share, corr = np.full(bits, 0.5), np.eye(bits)
        for n in (0, 1, 1000, 10**5, 10**7):
            parts = simhash.plan(n, share, corr, distance)
            assert sum(t + 1 for _, t in parts) == distance + 1
            lookups = sum(math.comb(len(g), k) for g, t in parts for k in range(t + 1))
            assert lookups < 10**6
            for _ in range(100):
                x = int.from_bytes(rng.bytes(bits // 8), "little")
                y = x ^ sum(1 << int(b) for b in rng.choice(bits, distance, replace=False))
                assert any(sum((x ^ y) >> b & 1 for b in g) <= t for g, t in parts)


def test_linear_hash_is_linear():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, (2, 100)).astype(np.uint64)
    assert (simhash.linear_hash(a ^ b) == simhash.linear_hash(a) ^ simhash.linear_hash(b)).all()
