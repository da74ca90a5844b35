"""Profiles, precedence of layers, and validation."""

from pyspark.sql import functions as F

from mediaops import schemas
from mediaops.operators import settings as s

EMPTY_USER = {name: None for name in schemas.PROFILES.names}


def user_profiles(spark, *given):
    return spark.createDataFrame([tuple({**EMPTY_USER, **g}[n] for n in schemas.PROFILES.names) for g in given], schemas.PROFILES)


def profiles(spark, *given):
    return s.overlay_profiles(s.builtin_profiles(spark), user_profiles(spark, *given))


def one(profiles_df, name):
    return profiles_df.filter(F.col("name") == name).first()


def test_user_fields_lie_over_built_in_ones(spark):
    merged = profiles(spark, {"name": "web", "crf": 30, "codec": ""}, {"name": "custom", "codec": "vp9"},
                      {"name": "mobile", "extra_args": []}, {"name": "archive", "crf": 0})
    web, custom = one(merged, "web"), one(merged, "custom")
    assert (web.crf, web.codec, web.audio_codec, web.container, web.extra_args, web.source) == (
        30, "h264", "aac", "mp4", ["-movflags", "+faststart"], "overridden")
    assert (custom.codec, custom.crf, custom.source) == ("vp9", None, "config")
    assert one(merged, "mobile").extra_args == [] and one(merged, "archive").crf == 0
    assert one(merged, "av1").source == "built-in" and one(merged, "does-not-exist") is None
    assert merged.count() == 6


def test_catalog_is_sorted(spark):
    catalog = s.profile_catalog(profiles(spark, {"name": "custom", "codec": "vp9"})).collect()
    assert [r.name for r in catalog] == ["archive", "av1", "custom", "mobile", "web", "web-hevc"]
    assert [(r.codec, r.crf, r.description) for r in catalog if r.name == "custom"] == [("vp9", "-", "-")]


JOBS = "job_id bigint, owner bigint, site bigint, profile string, codec string, crf int, preset string, container string, extra_args array<string>"


def resolved(spark, jobs, env=None, config=None, **kw):
    env = spark.createDataFrame(env or [], "owner bigint, hwaccel string, crf int")
    config = spark.createDataFrame(config or [], "site bigint, codec string, preset string, audio_codec string")
    df = s.resolve_settings(spark.createDataFrame(jobs, JOBS), profiles(spark, **kw), env=(env, "owner"), config=(config, "site"))
    return {r.job_id: r for r in df.collect()}


def test_layers_in_order(spark):
    got = resolved(
        spark,
        [(1, 1, 1, "web", "av1", None, None, None, ["-vf", "x"]), (2, 1, 2, "web", None, None, None, None, None),
         (3, 2, 1, "archive", None, 10, None, ".mkv", None), (4, 9, 9, None, None, None, None, None, None),
         (5, 9, 9, "nope", None, None, None, None, None), (6, 9, 9, "archive", None, None, None, "", [])],
        env=[(1, "vaapi", 7)], config=[(1, "vp9", "slow", "")],
    )
    assert (got[1].codec, got[1].crf, got[1].preset, got[1].hwaccel) == ("av1", 7, "slow", "vaapi")
    assert got[1].extra_args == ["-movflags", "+faststart", "-vf", "x"]
    assert (got[2].codec, got[2].crf, got[2].preset, got[2].container, got[2].audio_codec) == ("h264", 7, "fast", "mp4", "aac")
    assert (got[3].codec, got[3].crf, got[3].container, got[3].audio_codec) == ("vp9", 10, "mkv", "copy")
    assert (got[4].codec, got[4].crf, got[4].preset, got[4].hwaccel, got[4].suffix, got[4].profile_known) == (
        "h265", 23, "medium", "auto", ".out", False)
    assert (got[5].profile, got[5].profile_known) == ("nope", False)
    assert (got[6].crf, got[6].container, got[6].extra_args) == (18, "", [])


def test_all_violations_are_reported(spark, rows):
    good = {"job_id": 1, "profile": "", "profile_known": False, "codec": "h265", "crf": 23, "decode_threads": 0, "hwaccel": "auto",
            "hwdecode": "auto", "audio_codec": "copy", "subs": "copy", "inplace": False, "output_dir": "", "container": ""}
    bad = {**good, "job_id": 2, "codec": "h256", "crf": 60, "inplace": True, "output_dir": "/o", "container": "mp4"}
    worse = {**good, "job_id": 3, "profile": "nope", "decode_threads": -1, "hwaccel": "cuda", "hwdecode": "maybe",
             "audio_codec": "wav", "subs": "burn", "crf": 51}
    found = s.validate_settings(spark.createDataFrame([good, bad, worse]))
    assert sorted(rows(found)) == sorted([
        *[(2, p) for p in ("unknown_codec", "crf_out_of_range", "inplace_with_output_dir", "inplace_with_container")],
        *[(3, p) for p in ("unknown_profile", "negative_decode_threads", "unknown_hwaccel", "unknown_hwdecode",
                           "unknown_audio_codec", "unknown_subs")],
    ])


def test_known_modes_pass(spark):
    base = {"job_id": 1, "profile": "web", "profile_known": True, "codec": "AVC", "crf": 0, "decode_threads": 3, "hwaccel": "SW",
            "hwdecode": "", "audio_codec": "OPUS", "subs": "Drop", "inplace": True, "output_dir": "", "container": ""}
    assert s.validate_settings(spark.createDataFrame([base])).count() == 0
