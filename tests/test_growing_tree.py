"""The tree that the live listing is tried on is made by all cores, also where its rows come in one partition."""

import os

from mediaops.plans import catalog
from mediaops.schemas import BIG, INT, TEXT, table

TREE = table(rel_path=TEXT, bytes=INT, mtime=BIG, symlink=TEXT, hard_link=TEXT, broken_link=TEXT, loop=TEXT)


def test_a_tree_is_made_by_many_tasks(spark, tmp_path):
    rows = [(f"n{k % 3}/m/{k}.mkv", k, 1_600_000_000 + k, f"n{k % 3}/m/soft-{k}" if k % 5 == 0 else None, f"n{k % 3}/m/hard-{k}" if k % 7 == 0 else None,
             f"n{k % 3}/m/broken-{k}" if k % 10 == 0 else None, f"n{k % 3}/m/loop-{k}" if k % 15 == 0 else None) for k in range(60)]
    context = spark.sparkContext
    for n in range(2):
        context.setJobGroup(f"grow-{n}", "")
        catalog._grow_tree(spark.createDataFrame(rows, TREE).coalesce(1), str(tmp_path))
        context.setLocalProperty("spark.jobGroup.id", None)
        jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup(f"grow-{n}")]
        stages = [context.statusTracker().getStageInfo(s) for j in jobs for s in j.stageIds]
        assert max(s.numTasks for s in stages if s) >= context.defaultParallelism
        for path, size, mtime, soft, hard, broken, loop in rows:
            info = os.stat(tmp_path / path)
            assert (info.st_size, int(info.st_mtime), info.st_nlink) == (size, mtime, 2 if hard else 1)
            assert not soft or os.readlink(tmp_path / soft) == str(tmp_path / path)
            assert not hard or os.path.samefile(tmp_path / hard, tmp_path / path)
            assert not broken or not os.path.exists(tmp_path / broken)
            assert not loop or os.readlink(tmp_path / loop) == str(tmp_path)
