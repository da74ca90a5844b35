"""MinHash classes against comparing all pairs, and star components."""

import re
from collections import Counter

import numpy as np
import pytest
from mediaops.llm import minhash, stars
from mediaops.llm.components import components
from pyspark.sql import functions as F

LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k:k + width]) for k in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def plain(rows):
    """[(id, set size, component, kept)] by comparing all pairs of rows."""
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if x and y and (x == y or 100 * len(x & y) >= 80 * len(x | y)):
                root[find(a)] = find(b)
    least = {}
    for i, (name, *_) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return [(r[0], len(s), least.get(find(i)) if s else r[0], r[0] == (least.get(find(i)) if s else r[0])) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def near_copies():
    draw = np.random.Generator(np.random.PCG64(5))
    base = [f"v{k}" for k in range(100)]
    rows = []
    for i in range(80):
        words = list(base)
        for k in draw.choice(100, int(draw.integers(0, 5)), replace=False):
            words[k] = f"edit{i}"
        rows.append((1000 + i, " ".join(words)))
    # Unlike texts that share a passage; a chain, each text without some of the one before; rows of one id, and without id.
    rows += [(1100 + i, " ".join(base[:30] + [f"t{i}x{k}" for k in range(12)])) for i in range(60)]
    rows += [(1200 + i, " ".join(f"c{k}" for k in range(2 * i, 2 * i + 60))) for i in range(12)]
    rows += [(1300, " ".join(f"d{k}" for k in range(60))), (1300, " ".join(f"e{k}" for k in range(60))), (1301, " ".join(f"d{k}" for k in range(1, 60))),
             (1302, " ".join(f"e{k}" for k in range(1, 60))), (None, " ".join(f"c{k}" for k in range(200, 260))), (1303, " ".join(f"c{k}" for k in range(201, 261))),
             (None, " ".join(f"f{k}" for k in range(60))), (None, " ".join(f"f{k}" for k in range(2, 60)))]
    return rows


@pytest.mark.parametrize("rounds, tile", [(1, 256), (0, 4)])
def test_classes(spark, odd_documents, odd_rows, monkeypatch, rounds, tile):
    """Also without hubs, all in small tiles."""
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "TILE", tile)
    docs = odd_documents.unionByName(spark.createDataFrame(near_copies(), "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.withColumns({c: F.lit("own") for c in ("bucket", "buckets", "marks", "print", "part", "hub", "a", "b", "id")})
    out = [tuple(r) for r in minhash.minhash_classes(docs, width=4).collect()]
    assert sorted(out, key=str) == sorted(plain([r[:2] for r in odd_rows] + near_copies()), key=str)
    assert Counter(r[2] for r in out)[1000] > 40


def test_no_rows(spark, no_documents):
    out = minhash.minhash_classes(no_documents)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == 0


def test_star_components(spark):
    pairs = [(i, i + 1) for i in range(0, 60, 2)] + [(i + 1, i + 2) for i in range(0, 60, 3)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (99, 98), (98, 99)]
    pairs += [(159, 203), (203, 202)]
    links = spark.createDataFrame(pairs, "a long, b long")
    assert sorted(map(tuple, stars.star_components(links).collect())) == sorted(tuple(r) for r in components(links).collect())
    assert stars.star_components(links.limit(0)).count() == 0


def test_minima_estimate_similarity():
    draw = np.random.Generator(np.random.PCG64(1))
    x = draw.integers(0, 2**63, 900, dtype=np.uint64)
    least = minhash.minima([x[:810], x[90:], x[:5], np.concatenate([x[:5], x[:5]])])
    assert 0.65 < (least[0] == least[1]).mean() < 0.93 and (least[2] == least[3]).all()
    keys = minhash.buckets(least)
    assert keys.shape == (4, 32) and (keys[2] == keys[3]).all() and len(set(keys[0])) == 32 and (keys[0] == keys[1]).any()


def test_bitmaps_never_rule_out_a_link():
    draw = np.random.Generator(np.random.PCG64(3))
    for _ in range(300):
        pool = np.unique(draw.integers(0, 2**63, int(draw.integers(2, 700)), dtype=np.uint64))
        x, y = (draw.permutation(pool)[:max(1, int(len(pool) * draw.uniform(0.75, 1)))] for _ in range(2))
        both = len(np.intersect1d(x, y))
        maps = [np.frombuffer(minhash.bitmap(s), np.uint8)[None, :] for s in (x, y)]
        size = min(m.shape[1] for m in maps)
        near = minhash.may_be_similar(len(x), minhash.folded(maps[0], size)[0], np.array([len(y)]), minhash.folded(maps[1], size), 80)[0]
        assert near or 100 * both < 80 * (len(x) + len(y) - both)
    far = np.unique(draw.integers(0, 2**63, 1000, dtype=np.uint64))
    maps = [np.frombuffer(minhash.bitmap(s), np.uint8)[None, :] for s in (far[:600], far[150:750])]
    assert not minhash.may_be_similar(600, maps[0][0], np.array([600]), maps[1], 80)[0]


def test_forest_connects_once():
    a, b = np.array([1, 2, 3, 1, 9, 5]), np.array([2, 3, 1, 3, 1, 6])
    assert minhash.forest(a, b, np.array([5, 0, 1, 2, 3, 4])).tolist() == [5, 0, 1, 4]
    assert minhash.forest(a[:0], b[:0], np.zeros(0, np.int64)).tolist() == []
