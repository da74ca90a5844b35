"""Secrets, personal data, quality rules and pieces against plain versions."""

import re
from collections import Counter
from hashlib import sha256

import pytest
from mediaops.llm import personal_data, pieces, quality_rules, secrets
from mediaops.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, tuple(r)) for r in df.collect()), key=str)


def digest(spans):
    return sha256(",".join(spans).encode()).hexdigest()


def plain_secrets(text):
    assign = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


@pytest.fixture(scope="module")
def models(spark):
    return secrets.default_models(spark, secrets.ordinary_strings(spark.read.parquet(f"{SF}/benchmark.parquet")))


def test_secrets(odd_documents, odd_rows, models):
    out = by_id(secrets.digest(odd_documents, models))
    assert len(out) == len(odd_rows)
    expected = sorted(((i, digest(plain_secrets(t or ""))) for i, t, _ in odd_rows), key=str)
    assert sorted(((r[2][0], r[2][4]) for r in out), key=str) == expected
    found = {r[2][0]: r[2] for r in out}
    assert found[23][5] == "markov:0:32" and found[23][6] == 1 and found[22][1:4] == (1, 1, 0)
    kept = secrets.find_secrets(odd_documents, models)
    assert kept.count() == len(odd_rows) and kept.columns[-1] == "secrets"
    hidden = {r.doc_id: r.text for r in secrets.redact(odd_documents, models).collect()}
    assert hidden[23] == "[secret] is not like the others" and hidden[1] is None and hidden[2] == ""
    assert "0123456789abcdef" not in hidden[21] and hidden[21].startswith("[secret]")


def test_models_tell_held_out_strings(spark, models):
    fresh = list(secrets.random_strings(200, seed=99))
    assert sum(models.score(s) > models.threshold for s in fresh) > 0.9 * len(fresh)
    ordinary = ["documentation_values", "personaldataextraction", "whitespace-tokenizer", "configurations_of_text"]
    assert all(models.score(s) <= models.threshold for s in ordinary)
    assert not secrets.train(spark.createDataFrame([], "token string, random boolean")).ratio.any()


def luhn(digits):
    values = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def plain_personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern, valid in rules for m in re.finditer(pattern, text) if valid(m)]


HARD = [
    "a@b.c_d@e.f x@y.z@q.r.s", "@a.b c@d .@a.b %+-@x-.y", "1.2.3.4.5.6.7.8 01.002.0003.0255 256.1.1.1 9999.1.1.1 0.0.0.0", "1" * 3000, "1 " * 2000,
    "4111-1111-1111-1111 4111111111111111 41111111111111110 4111  1111", "+1+22 3333 4444 (5) +49.30-123456- +1 2", "+" * 100, "é@ü.de 🎉a@b.co🎉 12.34.56.78🎉",
    "\x01a@b.cd\x01\x02 1.1.1.1\x01", "a." * 3000 + "@b.c", "x@" + "y." * 3000 + "z", "",
]


def test_personal_data(spark, odd_documents, odd_rows):
    hard = spark.createDataFrame([(100 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    texts = [(i, t) for i, t, _ in odd_rows] + [(100 + i, t) for i, t in enumerate(HARD)]
    rows = personal_data.digest(odd_documents.select("doc_id", "text").unionByName(hard)).collect()
    assert len(rows) == len(texts)
    assert sorted(((r.doc_id, r.base_sha256) for r in rows), key=str) == sorted(((i, digest(plain_personal(t or ""))) for i, t in texts), key=str)
    assert personal_data.find_personal_data(odd_documents).count() == len(odd_rows)


def test_checked_accounts_and_context(spark):
    texts = [(1, "iban GB82 WEST 1234 5698 7654 32 here"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "ssn 078-05-1120"), (4, "part 078-05-1120"), (5, "DE89370400440532013000")]
    found = personal_data.find_personal_data(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    kinds = {r.doc_id: [(s.kind, s.start, s.end, round(s.score, 1)) for s in r.personal if s.kind in personal_data.KINDS[4:]] for r in found}
    assert kinds == {1: [("iban", 5, 32, 1.1)], 2: [], 3: [("national_id", 4, 15, 0.6)], 4: [], 5: [("iban", 0, 22, 0.8)]}


def plain_statistics(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {p for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def plain_lost(rows, share, least):
    """Words in lines that more than the limits of the host's distinct texts hold, per row."""
    normal = lambda x: " ".join(WORD.findall(x)).translate({c: c + 32 for c in range(65, 91)})
    texts = {}
    for _, text, host in rows:
        if WORD.search(text or ""):
            texts.setdefault(host, set()).add(text)
    held = Counter((h, line) for h, some in texts.items() for t in some for line in {normal(x) for x in t.split("\n")} if line)
    common = {k for k, n in held.items() if n > least and n > share * len(texts[k[0]])}
    return [sum(len(WORD.findall(x)) for x in (t or "").split("\n") if (h, normal(x)) in common) for _, t, h in rows]


def test_quality_rules(spark, odd_rows, odd_documents):
    footer = "All Rights  reserved by the host"
    shared = [(200 + i, f"{' '.join(f'w{i}x{k}' for k in range(60 if i % 2 else 10))}\n{footer.lower() if i % 3 else footer}\nnote {i}", "host") for i in range(12)]
    shared += [(220, "\n".join([footer] * 12 + ["a b c d e f"]), "host"), (200, shared[0][1], "host")]
    rows = odd_rows + shared
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = quality_rules.quality_verdicts(docs, share=0.2, least=5).collect()
    expected = []
    for (i, text, _), lost in zip(rows, plain_lost(rows, 0.2, 5), strict=True):
        s = plain_statistics(text or "")
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        expected.append((i, *s, lost, failed, not failed and lost <= 0.7 * s[0]))
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")) for r in out), key=str) == sorted(expected, key=str)
    kept = {r.doc_id: r.text for r in quality_rules.quality_filter(docs, share=0.2, least=5).collect()}
    assert 201 in kept and footer.lower() not in kept[201].lower() and kept[201].endswith("note 1") and 200 not in kept and 220 not in kept
    odd = quality_rules.quality_filter(odd_documents)
    assert odd.columns == odd_documents.columns and all(r.n_words == "own n_words" and r.lines == "own lines" for r in odd.collect())


def test_pieces(odd_documents, odd_rows):
    import sentencepiece
    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    hard = ["", " ", "  ", "a ", " a", "a  b", "▁", "▁▁a ▁b", "a\nb \n c", "▁x y", "🎉🎉 é \x00 �", "<s> </s> <unk> <0x0A>", "x" * 300, " " * 40 + "y", "\t tab"]
    table = pieces.Pieces(path)
    for text in hard + [t for _, t, _ in odd_rows if t]:
        ids = library.encode(text)
        assert table.encode(text) == ids, text[:40]
        assert "".join(e[1] for e in table.chunks(text))[1:] == library.decode(ids) == table.decode(ids), text[:40]
    out = sorted((tuple(r) for r in pieces.digest(odd_documents, path).collect()), key=str)
    ids = [(i, library.encode(t or "")) for i, t, _ in odd_rows]
    assert out == sorted(((i, len(x), digest(map(str, x)), sha256(library.decode(x).encode()).hexdigest()) for i, x in ids), key=str)
    assert pieces.encode_pieces(odd_documents, path).count() == len(odd_rows)


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    table = pieces.Pieces(tokenizer_path("piece_bpe_32k.model"))
    assert [table.decode(table.encode(t)) for t in ("a b c d e", "e f g", "a a a h")] == ["a b c d e", "e f g", "a a a h"]


def test_empty_tables(no_documents, models):
    assert secrets.digest(no_documents, models).count() == 0
    assert personal_data.digest(no_documents).count() == 0
    assert quality_rules.quality_verdicts(no_documents).count() == 0
    assert quality_rules.quality_filter(no_documents).count() == 0
    assert pieces.digest(no_documents, tokenizer_path("piece_bpe_32k.model")).count() == 0
