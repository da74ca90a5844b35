import random

import numpy as np
from mediaops.llm import jaccard_join
from mediaops.llm.hashing import shingles, strings


def test_texts_are_posted_once_and_fetched_for_few_pairs(spark, monkeypatch):
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefghilmnoprstu", k=7)) for _ in range(600)]
    # Members share about 0.65 of their shingles with each other, and the last two nearly all.
    texts = [" ".join([*words[:450], *("".join(draw.choices("abcdefghilmnoprstu", k=8)) for _ in range(115))]) for _ in range(12)]
    texts.append(texts[-1] + " one more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    posted, compared = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counting(inner, count):
        def made(*args):
            run = inner(*args)

            def counted(batches):
                def seen():
                    for batch in batches:
                        count.add(batch.num_rows)
                        yield batch
                yield from run(seen())
            return counted
        return made

    monkeypatch.setattr(jaccard_join, "_prefixes", counting(jaccard_join._prefixes, posted))
    monkeypatch.setattr(jaccard_join, "_similar", counting(jaccard_join._similar, compared))
    classes = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(docs).collect()}

    import pyarrow as pa
    data, offsets = strings(pa.array(texts))
    sets = [set(s.tolist()) for s in shingles(data, offsets)]
    linked = [(i, j) for j in range(13) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert linked == [(11, 12)]
    assert classes == {i: min(i, 11) for i in range(13)}
    assert posted.value == len(texts)
    assert compared.value <= 3


def test_wide_bitmaps_let_all_similar_pairs_pass():
    import pyarrow as pa
    draw = np.random.Generator(np.random.PCG64(9))
    rows = []
    for k in range(300):
        base = np.unique(draw.integers(0, 2**63, 400, dtype=np.uint64))
        other = np.unique(np.concatenate([base[: 400 - k], draw.integers(0, 2**63, k // 2, dtype=np.uint64)]))
        rows.append((k, -k, len(base), len(other), jaccard_join._wide(base), jaccard_join._wide(other), len(np.intersect1d(base, other))))
    columns = list(zip(*rows, strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns[:6]], names=["a", "b", "n_a", "n_b", "wide_a", "wide_b"])
    passed = {a for out in jaccard_join._wide_possible(80)([batch]) for a in out.column("a").to_pylist()}
    similar = {k for k, _, n_a, n_b, _, _, both in rows if 100 * both >= 80 * (n_a + n_b - both)}
    assert similar <= passed and 0 < len(similar) and len(passed) < 2 * len(similar) < 300
