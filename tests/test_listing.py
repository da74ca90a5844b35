"""The live listing as a data source, newest history by months, packed orders, and roots filtered before directories are rows."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from mediaops import schemas
from mediaops.functions import paths
from mediaops.functions.packing import packed_order
from mediaops.operators import history, rules
from mediaops.sources import ledger, listing
from mediaops.sources.inventory import list_tree


@pytest.fixture
def tree(tmp_path):
    for k in range(60):
        folder = tmp_path / f"d{k % 7}" / f"e{k % 3}" / ("deep/er" if k % 5 == 0 else "")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{k}.{['mkv', 'MP4', 'txt', 'a.mkv'][k % 4]}").write_bytes(b"x" * k)
    (tmp_path / "plain").write_bytes(b"")
    (tmp_path / ".mkv").write_bytes(b"1")
    os.link(tmp_path / "d0/e0/deep/er/f0.mkv", tmp_path / "hard.mkv")
    os.symlink(tmp_path / "d0/e0/deep/er/f0.mkv", tmp_path / "soft.MKV")
    os.symlink(tmp_path, tmp_path / "d1/loop.mkv")
    os.symlink(tmp_path / "nothing", tmp_path / "broken.mkv")
    return str(tmp_path)


@pytest.mark.parametrize("slices", [1, 3, 40])
def test_the_source_lists_what_the_levels_list(spark, tree, slices):
    columns = schemas.INVENTORY.names
    expected = sorted(map(tuple, list_tree(spark, tree).select(*columns).collect()))
    found = listing.live_inventory(spark, tree + "/", slices=slices)
    assert found.schema == schemas.INVENTORY and sorted(map(tuple, found.collect())) == expected
    assert len(expected) == 64 and {r[2] for r in expected} == {"mkv", "mp4", "txt", ""}
    some = listing.live_inventory(spark, tree, ["MKV", ".mp4"], slices)
    assert sorted(map(tuple, some.collect())) == [r for r in expected if r[2] in ("mkv", "mp4")]
    assert some.filter("size > 30").count() == sum(r[3] > 30 for r in expected if r[2] in ("mkv", "mp4"))


def test_extensions_are_pushed_into_the_listing(tree):
    reader = listing.TreeReader(tree, 4)
    size = GreaterThan(("size",), 3)
    assert list(reader.pushFilters([In(("ext",), ("mkv", "txt")), size, EqualTo(("ext",), "mkv")])) == [size]
    names = [row[0] for part in reader.partitions() for row in reader._files(part)]
    assert names and all(n.lower().endswith(".mkv") for n in names)
    with pytest.raises(OSError):
        listing.TreeReader(tree + "/nowhere", 4).partitions()


def attempts(spark, rows):
    return spark.createDataFrame(rows, "source_path string, source_mtime bigint, source_size bigint, output_size bigint, encoder string, elapsed_ms bigint, status string, completed_at bigint")


@pytest.mark.parametrize(("per_month", "months"), [(30, 1), (5, 4), (1, 6)])
def test_newest_history_reads_the_last_months(spark, tmp_path, per_month, months):
    day = 86400
    rows = [(f"/{m}/{k}", 1, 10, 5, "x", 1000, "failed" if k % 2 else "done", 1_600_000_000 + 31 * day * m + k) for m in range(6) for k in range(per_month)]
    ledger.append_history(attempts(spark, rows), str(tmp_path / "h"))
    assert len(ledger.history_months(spark, str(tmp_path / "h"))) == 6
    df = history.recent_stored_history(spark, str(tmp_path / "h"), 20)
    expected = sorted(rows, key=lambda r: (-r[7], r[0]))[:20]
    assert [(r.source_path, r.completed_at) for r in df.collect()] == [(r[0], r[7]) for r in expected]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    newest = ledger.history_months(spark, str(tmp_path / "h"))
    if months < 6:
        assert all((m in plan) == (i < months) for i, m in enumerate(newest))
    failed = history.recent_stored_history(spark, str(tmp_path / "h"), 3, failed_only=True)
    assert [r.source_path for r in failed.collect()] == [r[0] for r in sorted((r for r in rows if r[6] == "failed"), key=lambda r: (-r[7], r[0]))[:3]]


def test_packed_orders_sort_as_tuples(spark):
    draw = random.Random(3)
    rows = [(draw.choice([None, -5, 0, 7, 10**12]), draw.choice([None, 0, 3, 999]), draw.randint(0, 10**9 - 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint").withColumn("o", packed_order(F.col("a"), (F.col("b"), 3), (F.col("c"), 9)))
    got = [(-1 if r.a is None else r.a, r.b or 0, r.c) for r in df.orderBy("o").collect()]
    assert got == sorted(got)
    with pytest.raises(Exception, match="does not fit 3 digits"):
        spark.createDataFrame([(1, 1000)], "a bigint, b bigint").select(packed_order(F.col("a"), (F.col("b"), 3))).collect()
    grouped = df.groupBy("b").agg(F.max_by(F.col("c") > 5, "o"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in grouped


def test_programs_are_found_behind_the_filter_of_roots(spark):
    draw = random.Random(9)
    roots = [f"/r{k}/s{k % 5}" for k in range(300)] + ["/", "/a b", "/r1", None, "rel"]
    programs = spark.createDataFrame([(str(k), r, ["mkv"] if k % 2 else ["mkv", ".MP4", "mkv"], []) for k, r in enumerate(roots)],
                                     "id string, src string, ext array<string>, rules array<struct<when:array<struct<field:string,op:string,value:string>>,do:struct<cmd:string,args:array<string>>>>")
    files = [(f"/r{draw.randint(0, 400)}/s{draw.randint(0, 5)}/x{k}/f.{e}", e) for k in range(400) for e in ("mkv", "mp4")] + [("/a b/c.mkv", "mkv"), ("top.mkv", "mkv")]
    df = spark.createDataFrame(files, "path string, ext string")
    expected = sorted((p, str(k)) for p, e in files for k, r in enumerate(roots) if r is not None and e in (["mkv"] if k % 2 else ["mkv", "mp4"])
                      and p.startswith("/") and (p.startswith(r + "/") or r == "/"))
    assert sorted((r.path, r.program_id) for r in rules.assign_programs(df, programs).collect()) == expected
    words = rules._root_filter(programs.select(paths.normalize_root(F.col("src")).alias("_root")).filter("_root IS NOT NULL")).first().words
    assert len(words) == rules.ROOT_BITS // 64 and sum((w & (2**64 - 1)).bit_count() for w in words) <= len(roots)
