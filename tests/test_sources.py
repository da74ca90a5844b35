"""Live listings, stored inventories, probe files and the ledger."""

import os

import pytest

from mediaops.sources import inventory, ledger, probes, workspace


def make(path, text="x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_scan_follows_the_allow_list(spark, tmp_path):
    for name in ("a.mkv", "sub/b.MP4", "sub/c.txt", "d.mp4", "sub/deep/.hidden.mkv", "noext", "sub/e.transcoded.mkv"):
        make(tmp_path / name, name)
    found = {r.rel_path: r for r in inventory.scan_inventory(spark, str(tmp_path), ["mkv", ".mp4"]).collect()}
    assert sorted(found) == ["a.mkv", "d.mp4", "sub/b.MP4", "sub/deep/.hidden.mkv", "sub/e.transcoded.mkv"]
    b = found["sub/b.MP4"]
    info = os.stat(tmp_path / "sub/b.MP4")
    assert (b.path, b.ext, b.size, b.mtime, b.mode, b.links, b.is_symlink) == (
        str(tmp_path / "sub/b.MP4"), "mp4", 9, int(info.st_mtime), info.st_mode, 1, False)


def test_hard_links_are_counted(spark, tmp_path):
    make(tmp_path / "a.mkv")
    os.link(tmp_path / "a.mkv", tmp_path / "b.mkv")
    assert [r.links for r in inventory.scan_inventory(spark, str(tmp_path), ["MKV"]).collect()] == [2, 2]


def test_symlinks(spark, tmp_path):
    make(tmp_path / "lib/a.mkv", "film")
    make(tmp_path / "elsewhere/target.mkv", "twelve bytes")
    (tmp_path / "lib/loop").symlink_to(tmp_path / "lib")
    (tmp_path / "lib/linked.mkv").symlink_to(tmp_path / "elsewhere/target.mkv")
    (tmp_path / "lib/broken.mkv").symlink_to(tmp_path / "nowhere.mkv")
    found = {r.rel_path: (r.size, r.is_symlink) for r in inventory.scan_inventory(spark, str(tmp_path / "lib"), ["mkv"]).collect()}
    assert found == {"a.mkv": (4, False), "linked.mkv": (12, True)}


def test_only_an_unreadable_root_is_an_error(spark, tmp_path):
    with pytest.raises(OSError):
        inventory.list_tree(spark, str(tmp_path / "missing"))
    assert inventory.list_tree(spark, str(tmp_path)).count() == 0


def test_paths_in_walking_order(spark, tmp_path):
    for name in ("b.mkv", "a/z.mkv", "a.mkv", "a/b/c.mkv", "a-1/x.mkv"):
        make(tmp_path / name)
    listed = [r.path[len(str(tmp_path)) + 1:] for r in inventory.list_paths(inventory.list_tree(spark, str(tmp_path))).collect()]
    walked = []

    def walk(folder, prefix):
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            if entry.is_dir():
                walk(entry.path, f"{prefix}{entry.name}/")
            else:
                walked.append(prefix + entry.name)

    walk(tmp_path, "")
    assert listed == walked


def test_stored_inventory(spark, tmp_path):
    make(tmp_path / "lib/a.mkv")
    make(tmp_path / "lib/b.avi")
    inventory.list_tree(spark, str(tmp_path / "lib")).write.json(str(tmp_path / "manifest"))
    read = inventory.read_inventory(spark, str(tmp_path / "manifest"), "json", [".AVI"])
    assert [r.rel_path for r in read.collect()] == ["b.avi"]


def test_probe_files(spark, tmp_path):
    make(tmp_path / "p/a b+c%.mkv.probe", "codec_name=h264\n")
    make(tmp_path / "p/c.mkv.probe", "")
    read = {r.path.rsplit("/", 1)[1]: r.text for r in probes.read_probe_files(spark, str(tmp_path / "p")).collect()}
    assert read == {"a b+c%.mkv": "codec_name=h264\n"}
    for location in (str(tmp_path / "p"), f"file://{tmp_path}/p/"):
        assert [r.path for r in probes.read_probe_files(spark, location, root="/mnt/media").collect()] == ["/mnt/media/a b+c%.mkv"]


def test_history_is_appended(spark, tmp_path):
    location = str(tmp_path / "history")
    first = spark.createDataFrame([("/a", 1, 10, 5, "h265", "x265", 23, 9, "failed", "x" * 500, 1700000000)],
                                  "source_path string, source_mtime bigint, source_size bigint, output_size bigint, target_codec string,"
                                  " encoder string, crf int, elapsed_ms bigint, status string, error_msg string, completed_at bigint")
    ledger.append_history(first, location)
    ledger.append_history(first.replace(1700000000, 1600000000, "completed_at"), location)
    stored = ledger.read_history(spark, location).orderBy("completed_at").collect()
    assert [(r.completed_month, r.source_codec, r.duration_ms, len(r.error_msg)) for r in stored] == [("2020-09", "", 0, 200), ("2023-11", "", 0, 200)]


def test_repeated_batches_replace_themselves(spark, tmp_path):
    location = str(tmp_path / "jobs")
    events = spark.createDataFrame([("r", "/a", "queued", 0.0, "", 1, -1)], "run_id string, source_path string, status string, pct double, speed string, ts bigint, seq bigint")
    ledger.append_job_events(events, location)
    for _ in range(2):
        ledger.append_job_events(events.replace("queued", "done"), location, batch_id=7)
    assert sorted(r.status for r in ledger.read_job_events(spark, location).collect()) == ["done", "queued"]


def test_work_folders_lie_under_the_shared_one(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    one, two = workspace.work_dir(spark, "x"), workspace.work_dir(spark, "x")
    assert one != two and one.startswith(f"{shared}/x-")


def test_mtime_is_cut_not_rounded(spark, tmp_path):
    file = tmp_path / "late.mkv"
    file.write_bytes(b"x")
    os.utime(file, ns=(0, 1_700_000_000_999_999_999))
    assert inventory.scan_inventory(spark, str(tmp_path), ["mkv"]).first().mtime == 1_700_000_000
