"""Long texts and lists, several blocks, repeated ids, clashing columns, and pages made around a known article."""

import random
import re
import time

import numpy as np
from mediaops.llm import jaccard_join, main_text, native_text, personal_data, quality_rules, source_mix, vector_search
from pyspark.sql import functions as F


def words(prefix, n):
    return " ".join(f"{prefix}{k}" for k in range(n))


def test_rows_of_one_id_keep_their_own_links(spark):
    x, y = words("x", 100), words("y", 100)
    docs = spark.createDataFrame([(1, x), (1, y), (2, x + " more"), (3, y + " more")], "doc_id long, text string")
    out = jaccard_join.jaccard_classes(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def boilerplate():
    """A small host whose license line fills most of five documents, and documents with a line or two of their own."""
    licence = "all of this is licensed under terms that nobody reads " * 8
    rows = [(i, f"{licence}\n{words(f'own{i}w', 15)}", "small") for i in range(5)]
    return rows + [(10 + i, f"{words(f'text{i}w', 60)}\n{words(f'more{i}w', 30)}", "small") for i in range(5)]


def test_the_line_rule_rejects_in_small_hosts(spark):
    docs = spark.createDataFrame(boilerplate(), "doc_id long, text string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.quality_verdicts(docs).collect()}
    assert all(not kept for i, (_, kept) in got.items() if i < 10) and all(kept for i, (_, kept) in got.items() if i >= 10)


def test_the_filter_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame(boilerplate(), "doc_id long, text string, source string").withColumns(
        {"_id": F.col("doc_id") * 7, "_host": F.lit(3.5), "_hash": F.array(F.col("doc_id")), "_own": F.lit("o"), "row": F.lit(True)})
    out = quality_rules.quality_filter(docs)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [(f.name, f.dataType.simpleString()) for f in docs.schema]
    assert sorted((r.doc_id, r._id, r._host, r._hash, r._own, r.row) for r in out.collect() if r.doc_id >= 10) == [(i, 7 * i, 3.5, [i], "o", True) for i in range(10, 15)]
    verdicts = quality_rules.quality_verdicts(docs)
    assert verdicts.columns[0] == "doc_id" and not {"_id", "_own"} & set(verdicts.columns)


def test_running_sums(spark):
    for n in (0, 1, 127, 128, 129, 500, 40_000):
        values = [(k * 37) % 11 for k in range(n)]
        got = spark.createDataFrame([(values,)], "v array<int>").select(native_text.running_sums(F.col("v")).alias("s")).first().s
        assert got == [0, *np.cumsum(values).tolist()]


def seconds(df):
    started = time.perf_counter()
    rows = df.collect()
    return time.perf_counter() - started, rows


def test_many_matches_take_time_in_proportion(spark):
    def text(n):
        return " ".join(f"some.one{k}@host{k % 7}.example.org and 123-45-{1000 + k % 9000}" for k in range(n))

    taken = {}
    for n in (200, 4_000, 16_000):
        docs = spark.createDataFrame([(1, text(n))], "doc_id long, text string")
        taken[n], (row,) = seconds(personal_data.find_personal_data(docs))
        mails = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text(n))]
        assert [(s.start, s.end) for s in row.personal if s.kind == "email"] == mails and len(mails) == n
    assert taken[16_000] < 5 * taken[4_000] + 2


def plain_dealt(rows, owed, most=3):
    out = []
    for size, taken in rows:
        due = owed + taken
        n = max(min(int(np.floor(due / size + 0.5)), most), 0)
        owed = due - n * size
        out.append(n)
    return owed, out


def test_dealing_is_exact_and_in_proportion(spark):
    draw = random.Random(4)
    taken = {}
    for n in (0, 1, 128, 300, 4_000, 16_000):
        rows = [(size := draw.randint(1, 900), draw.randint(0, 3 * size)) for _ in range(n)]
        df = spark.createDataFrame([(rows,)], "rows array<struct<size:bigint,taken:bigint>>").select(source_mix._dealt(F.col("rows"), F.lit(5), 3).alias("d"))
        taken[n], (row,) = seconds(df)
        assert (row.d.owed, row.d.copies) == plain_dealt(rows, 5)
    assert taken[16_000] < 5 * taken[4_000] + 2


def test_search_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vector_search, "SHARD_ROWS", 64)
    draw = np.random.Generator(np.random.PCG64(6))
    data = draw.integers(-3, 4, (600, 8)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vector array<double>").repartition(7)
    asked = rows.where("id % 10 = 0")
    exact = data @ data.T
    expected = []
    for q in range(0, 600, 10):
        best = sorted((-exact[q, i], i) for i in range(600) if i != q)[:5]
        expected += [(q, rank + 1, i, int(-s)) for rank, (s, i) in enumerate(best)]
    assert sorted(map(tuple, vector_search.top_k(rows, asked).collect())) == expected
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        df = vector_search.top_k(rows, asked)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(block" in plan and "group" in plan.split("hashpartitioning(block")[1][:60]
        assert sorted(map(tuple, df.collect())) == expected
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_links_belong_to_their_article():
    html = ("<nav><a href=x>menu</a></nav><article><h1>Title</h1><p><a href=1>A paragraph that is one long link to somewhere else, with nothing around it at all</a></p>"
            "<ul><li><a href=2>first</a></li><li><a href=3>second</a></li></ul><table><tr><td>cell</td><td><a href=4>linked</a></td></tr></table>"
            "<section class='related-work'><p>Others did this before.</p></section><div class='notice-of-appeal'>The notice was served.</div>"
            "<div class='related-posts'><a href=5>More</a></div><div class='cookie-notice'>We use cookies</div></article><footer>end</footer>")
    assert main_text.main_text(html).split("\n") == [
        "Title", "A paragraph that is one long link to somewhere else, with nothing around it at all", "first", "second", "cell", "linked",
        "Others did this before.", "The notice was served."]
    for name, outside in (("sidebar-left", True), ("ad-slot-2", True), ("comments-area", True), ("nav_primary", True), ("footer-top", True), ("has-sidebar", False),
                          ("article-header", False), ("commentary", False), ("menu-of-the-day", False), ("share-price-report", False), ("newsletter-signup", True)):
        assert bool(main_text._names(name)) == outside, name


def made_page(draw):
    """(html, text): an article between what is none of it, in the ways pages write such things."""
    stop = "the of and to in is was for on that with as by at from it this are be an".split()

    def sentence(n):
        return " ".join(draw.choice(stop) if k % 2 else "".join(draw.choices("abcdefghilmnorstu", k=draw.randint(3, 9))) for k in range(n)).capitalize() + "."

    def noise():
        inner = f"<a href='/{draw.random()}'>{sentence(3)}</a> {sentence(draw.randint(2, 40))}"
        return draw.choice([
            f"<nav><ul><li>{inner}<li>{inner}</ul></nav>", f"<aside><p>{inner}</p></aside>", f"<div class='ad box'>{inner}</div>", f"<div id='cookie-banner'><p>{inner}</p></div>",
            f"<form><p>{inner}</p><input name=q><select><option>a</select></form>", f"<script>var a='<p>{sentence(5)}</p>';</script>", f"<style>p{{}}</style><!-- {inner} -->",
            f"<section class='comments'><article><p>{inner}</p></article></section>", f"<div role='navigation'>{inner}</div>", f"<div class=\"sidebar-left\"><p>{inner}</p></div>"])

    blocks, inside = [], []
    for _ in range(draw.randint(1, 8)):
        text = sentence(draw.randint(1, 60))
        kind = draw.randrange(6)
        if kind == 0:
            other = sentence(4)
            inside.append(f"<p>{text}<p>{other}")
            blocks += [text, other]
        elif kind == 1:
            inside.append(f"<blockquote><p>{text}</p></blockquote>\n")
            blocks.append(text)
        elif kind == 2:
            inside.append(f"<h2>{text}</h2>")
            blocks.append(text)
        elif kind == 3:
            inside.append(f"<ul><li><a href=x>{text}</a></li><li>a &amp; b&nbsp;c</li></ul>")
            blocks += [text, "a & b c"]
        elif kind == 4:
            inside.append(f"<p>\n  <b>{text}</b>  <br/> x&#233;y\n</p>")
            blocks.append(f"{text} xéy")
        else:
            inside.append(f"<div><p><a href=x>{text}</a></p></div>")
            blocks.append(text)
        if draw.random() < 0.4:
            inside.append(noise())
    tag = draw.choice(["article", "main", "main id=content", "article class='post has-sidebar'"])
    title = sentence(5)
    around = [noise() for _ in range(4)]
    body = f"{around[0]}<div class='wrapper'>{around[1]}<{tag}><header><h1>{title}</h1></header>{''.join(inside)}</{tag.split()[0]}>{around[2]}</div><footer>{around[3]}</footer>"
    return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{body}</body></html>", "\n".join([title, *blocks])


def test_articles_of_made_pages():
    draw = random.Random(12)
    for _ in range(400):
        html, text = made_page(draw)
        assert main_text.main_text(html) == text, html
