"""Main text of pages, SQL twins, and the pipeline stage by stage."""

import re
import sys
from hashlib import sha256
from pathlib import Path

import pytest
from mediaops.llm import main_text, secrets, stages
from mediaops.llm.queries import QUERIES, oracle_sql, tokenizer_path
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from test_table_operators import plain_components  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = "It was the first of the long paragraphs that the writer had set out in the order of the day, with all that is in it and more to come. " * 2

PAGES = [
    ("plain", "<html><body>Only &lt;this&gt; text.</body></html>", "Only <this> text."),
    ("article", f"<body><header>Site</header><nav><a href=/>Home</a></nav><article><header><h1>Title &amp; more</h1></header><p>{LONG}<p>Short.<br>Next<ul><li>point one</ul></article>"
     f"<aside>{LONG}</aside><div class='comments'><p>{LONG}</p></div><footer>&copy; x</footer>",
     f"Title & more\n{LONG.strip()}\nShort. Next\npoint one"),
    ("no article", f"<div id='main-menu'><p>{LONG}</p></div><div><p>Lead in</p><p>{LONG}</p><p>Coda</p></div><div class='sidebar widget'><p>{LONG}</p></div><p><a href=x>More links of all kinds</a></p>",
     f"Lead in\n{LONG.strip()}\nCoda"),
    ("comments inside", f"<article><p>{LONG}</p><section id=comments><p>{LONG}</p></section><form><label>mail</label><button>go</button></form><div class='cookie-notice'>{LONG}</div></article>", LONG.strip()),
    ("hidden", f"<article><p>{LONG}</p><p hidden>{LONG}</p><script>var a = '<p>no</p>';</script><style>p {{ }}</style><!-- <p>no</p> --></article>", LONG.strip()),
    ("broken", f"<article><p>{LONG}<b>bold<p>a < b and c > d<div>open <i", f"{LONG.strip()} bold\na < b and c > d\nopen"),
    ("spaces", f"<main><p>\n a&nbsp;b \t c\n</p><p>{LONG}</p></main>", f"a b c\n{LONG.strip()}"),
    ("empty", "", ""), ("null", None, ""), ("tags only", "<div><p></p></div>", ""), ("script never ends", "<script>x", ""),
]


@pytest.mark.parametrize(("name", "html", "text"), PAGES)
def test_main_text(name, html, text):
    assert main_text.main_text(html) == text


def test_long_pages_take_linear_time():
    assert main_text.main_text("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>").count("\n") == 2999
    assert main_text.main_text("<" * 100_000 + "<a \"" * 2000) is not None


def test_extract(spark):
    pages = spark.createDataFrame([(i, f"http://{n}", h) for i, (n, h, _) in enumerate(PAGES)] + [(None, None, "x")], "page_id long, url string, html string")
    out = {r.page_id: (r.url, r.text, r.n_chars) for r in main_text.extract(pages.withColumn("text", F.lit("own"))).collect()}
    assert out == {i: (f"http://{n}", t, len(t)) for i, (n, _, t) in enumerate(PAGES)} | {None: (None, "x", 1)}
    assert main_text.extract(pages.limit(0)).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="sample tables are not here")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sql = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        sql.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = sql.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted(result.fetchall(), key=str)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.skipif(not Path(SF).exists(), reason="sample tables are not here")
def test_pipeline(spark):
    import sentencepiece
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "secrets", "source_mix", "pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality = stages.quality(spark, docs, SF).cache()
    rows = {r.doc_id: r.text for r in docs.collect()}
    bad = {i for i, t in rows.items() if _fails(t or "")}
    assert {r.doc_id for r in quality.collect()} == set(rows) - bad
    one = stages.one_of_each(spark, quality, SF).cache()
    classes = plain_components([(r.doc_id, r.text) for r in quality.collect()])
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, c) in classes.items() if i == c)
    clean = stages.without_secrets(spark, one, SF).cache()
    assert clean.count() == one.count() and all(not secrets.spans_of(r.text, None) for r in clean.collect())
    mixed = stages.mixed(spark, clean, SF).cache()
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert all(x.columns == docs.columns for x in (quality, one, clean, mixed))
    out = corpus_pipeline.run(spark, SF).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    expected = [(r.doc_id, library.encode(r.text)) for r in mixed.collect()]
    assert sorted((r.doc_id, r.ids) for r in out) == sorted(expected)
    assert all(r.decoded_sha256 == sha256(library.decode(r.ids).encode()).hexdigest() and r.n_tokens == len(r.ids) for r in out)


def _fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(set(windows)) < len(windows) else set()
    inside = {p for i, w in enumerate(windows) if w in twice for p in (i, i + 1, i + 2)}
    return len(words) < 50 or 100 * len(inside) > 50 * len(words)


def test_pipeline_of_odd_and_no_documents(spark, odd_documents, no_documents):
    for docs in (no_documents, odd_documents.withColumns({"lang": F.lit("en"), "n_chars": F.lit(1).cast("long")})):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = corpus_pipeline.keep(stage(spark, docs, SF), "odd")
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_one_of_many_near_copies_passes_quality_and_join(spark):
    """30 near copies of several lines each: their lines are common, but one document of the group goes on."""
    line = lambda name, k: " ".join(f"{name}{k}w{j}" for j in range(12))
    rows = [(100 + i, "\n".join(line(f"edit{i}x", k) if k == i % 20 else line("same", k) for k in range(20)), "a") for i in range(30)]
    rows += [(500 + i, "\n".join(line(f"own{i}x", k) for k in range(8)), "a") for i in range(40)]
    docs = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, source string, lang string, n_chars long")
    quality = stages.quality(spark, docs, SF).cache()
    out = {r.doc_id: r.text for r in stages.one_of_each(spark, quality, SF).collect()}
    assert sorted(out) == [100, *range(500, 540)]
    assert out[100] == rows[0][1]


def test_mixing_keeps_rows_without_id_and_sources_near_target(spark):
    """Documents without id are mixed like others, and short documents make up for what a long one gives too much or too little."""
    words = lambda n, k: " ".join([f"w{k}"] * n)
    rows = [(None, words(40 + k % 7, k), "a") for k in range(60)] + [(1, words(4000, "long"), "b")] + [(100 + k, words(30, k), "b") for k in range(100)]
    rows += [(300 + k, words(50, k), "c") for k in range(200)] + [(900, "", "c"), (None, None, "c")]
    docs = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, source string, lang string, n_chars long")
    first, second = (sorted((tuple(r) for r in stages.mixed(spark, d, SF).collect()), key=str) for d in (docs, docs.repartition(5)))
    assert first == second
    sizes = spark.createDataFrame([(s, len((t or "").split())) for _, t, s in rows], "source string, size long")
    targets = {r.source: r.target for r in stages.source_mix.source_targets(sizes).collect()}
    for source, target in targets.items():
        assert abs(sum(len(r[1].split()) for r in first if r[2] == source) - target) <= 60, source
    assert {r[2] for r in first if r[0] is None} == {"a"} and max(first.count(r) for r in set(first)) <= 3
