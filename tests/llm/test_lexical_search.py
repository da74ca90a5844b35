"""Ranked search against plain scoring of every document."""

import math
import re
from collections import Counter

import numpy as np
from mediaops.llm import document_tree, lexical_search
from pyspark.sql import functions as F

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(documents, items, k=20):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t, *_ in documents]
    docs = [d for d in docs if d[2]]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for d in docs for t in d[1])
    texts = {}
    for i, t in items:
        texts[i] = max(texts.get(i, ""), t or "")
    out = []
    for item, text in texts.items():
        scored = []
        for i, tf, length in docs:
            m = 100 - 25 + 25 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms(text) if t in tf)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


def corpus():
    draw = np.random.Generator(np.random.PCG64(8))
    names = [f"w{k}" for k in range(400)] + ["Été", "東京", "x9"]
    chance = 1 / np.arange(1, len(names) + 1)
    rows = [(i, ", ".join(np.array(names)[draw.choice(len(names), int(draw.integers(1, 90)), p=chance / chance.sum())])) for i in range(700)]
    rows += [(5000 + i, rows[3][1]) for i in range(200)] + [(9000, "The " * 40_000)]
    items = [(i, " ".join(np.array(names)[draw.choice(len(names), int(draw.integers(1, 40)))])) for i in range(60)]
    items += [(60, None), (61, ""), (62, "...!"), (63, "unknown words"), (None, "W1 w2 w3"), (3, "zz"), (64, "w7 w7 W7 w9"), (65, rows[3][1])]
    return rows, items


def test_top_k(spark, odd_documents, odd_rows, monkeypatch):
    rows, items = corpus()
    docs = odd_documents.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("own") for c in ("id", "n", "item", "block", "terms")})
    expected = sorted(plain([r[:2] for r in odd_rows] + rows, items), key=str)
    assert sorted((tuple(r) for r in lexical_search.lexical_top_k(docs, table).collect()), key=str) == expected
    # In small packs and blocks.
    for name, value in (("PACK_DOCUMENTS", 100), ("PACK_ENTRIES", 1500), ("BLOCK_ITEMS", 7)):
        monkeypatch.setattr(lexical_search, name, value)
    assert sorted((tuple(r) for r in lexical_search.lexical_top_k(docs.coalesce(2), table).collect()), key=str) == expected
    assert lexical_search.lexical_top_k(docs.limit(0), table).count() == 0 == lexical_search.lexical_top_k(docs, table.limit(0)).count()


def test_tree_prunes_and_finds_all():
    draw = np.random.Generator(np.random.PCG64(2))
    vectors = [np.unique(draw.geometric(0.05, int(draw.integers(1, 40)))) for _ in range(3000)] + [np.array([1, 2, 3])] * 500
    starts = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    ranks, m = np.concatenate(vectors), draw.integers(75, 200, len(vectors))
    tf = draw.integers(1, 5, len(ranks))
    tree = document_tree.DocumentTree(starts, ranks, tf, m)
    for _ in range(20):
        query = np.unique(draw.geometric(0.05, 12))
        weights = draw.integers(0, 9000, len(query))
        exact = np.array([sum(int(weights[query == r][0]) * (1_000_000_000 * int(f) // (1000 * int(f) + 12 * int(mm))) for r, f in
                              zip(ranks[a:b], tf[a:b], strict=True) if r in query) for a, b, mm in zip(starts, starts[1:], m, strict=False)])
        places, scores = tree.best(query, weights, 20, 0, tree.order)
        best = np.lexsort((np.arange(len(exact)), -exact))[:20]
        assert tree.order[places].tolist() == best[exact[best] > 0].tolist() and scores.tolist() == exact[tree.order[places]].tolist()
    assert len(tree._children) > 10 and max(tree._level) > 2
