"""Passages of many words in several documents against a plain version."""

import random
import re

import pytest
from mediaops.llm import repeats


def plain_shared(rows, least):
    """Per row the words in windows of ``least`` words that a row of another id or text has too."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    having = {}
    for (i, t), w in zip(rows, split, strict=True):
        for k in range(len(w) - least + 1):
            having.setdefault(tuple(w[k:k + least]), set()).add((i, t))
    out = []
    for w in split:
        covered = set()
        for k in range(len(w) - least + 1):
            if len(having[tuple(w[k:k + least])]) > 1:
                covered.update(range(k, k + least))
        out.append(len(covered))
    return out


@pytest.mark.parametrize("least", [51, 5])
def test_shared_words(spark, odd_documents, odd_rows, least):
    draw = random.Random(5)

    def prose(n):
        return ["".join(draw.choices("abcdeé", k=draw.randint(1, 3))) for _ in range(n)]
    passage = prose(55)
    many = [(400, [*prose(30), "before", *passage, "after", *prose(20)]), (401, [*passage, "behind", *prose(40)]), (402, ["ahead", *passage[:50], "last"]), (403, passage[3:54]),
            (404, (own := prose(60)) + prose(3) + own), (405, ["same"] * 130), (406, ["same"] * 52), (407, [*prose(7), "within", *passage, *prose(3), "twice", *passage])]
    middle = prose(200)
    many += [(420 + i, prose(i) + middle[3 * i:3 * i + 70] + prose(5)) for i in range(25)]
    many = [(i, " ".join(w)) for i, w in many] + [(450, "\n\t".join(passage)), (None, " ".join(middle)), (None, " ".join(middle[20:]))]
    assert len(" ".join(passage[3:54]).encode()) < 400
    rows = [(i, t) for i, t, _ in odd_rows] + many
    docs = odd_documents.select("doc_id", "text").unionByName(spark.createDataFrame(many, "doc_id long, text string")).repartition(3)
    out = repeats.remove_repeats(docs, passage_words=least).collect()
    expected = plain_shared(rows, least)
    assert sorted(((r.doc_id, r.n_bytes, r.n_shared_words) for r in out), key=str) == sorted(
        ((i, len((t or "").encode()), n) for (i, t), n in zip(rows, expected, strict=True)), key=str)
    if least == 51:
        found = {r.doc_id: r for r in out}
        assert [found[i].n_shared_words for i in (400, 401, 402, 403, 404, 405)] == [55, 55, 0, 51, 0, 130]
        assert found[403].n_removed == found[401].n_removed == 0


def test_no_documents_share_nothing(no_documents):
    assert repeats.remove_repeats(no_documents, passage_words=51).count() == 0
