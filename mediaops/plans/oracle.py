"""The same questions in plain SQL, for checking the queries against DuckDB."""

from __future__ import annotations

from . import tables as t

_VIEWS = {
    "library": t.sql_select(t.LIBRARY, "orders"),
    "probe_text": t.sql_select(t.PROBE_TEXT, "library"),
    "transcodes": t.sql_select(t.TRANSCODES, "lineitem JOIN library ON l_orderkey = file_id"),
    "listing": """SELECT path FROM library UNION ALL
        SELECT regexp_replace(path, '\\.[^./]*$', '') || '.out.' || regexp_extract(path, '([^./]*)$', 1)
        FROM library WHERE file_id % 29 = 0""",
    "runs": t.sql_select(t.RUNS, "customer"),
    "jobs": t.sql_select(t.JOBS, "library JOIN orders ON file_id = orders.o_orderkey"),
    "progress": t.sql_select(t.PROGRESS, "events"),
    "evidence": t.sql_select(t.EVIDENCE, "events"),
    "programs": t.sql_select(t.PROGRAMS, "customer"),
    "region_programs": t.sql_select(t.REGION_PROGRAMS, "region"),
    "rule_text": t.sql_select(t.RULE_LINES, "orders"),
    "tree": t.sql_select(t.TREE, "customer"),
    "user_profiles": t.sql_select(t.USER_PROFILES, "supplier"),
    "job_specs": t.sql_select(t.JOB_SPECS, "orders"),
    "env_layer": t.sql_select(t.ENV_LAYER, "customer"),
    "config_layer": t.sql_select(t.CONFIG_LAYER, "nation"),
    "capability": """SELECT s_suppkey AS host, c.codec, b.backend,
        (s_suppkey * 7 + c.ix * 3 + b.ix * 5) % 6 = 0 AS works, (s_suppkey + c.ix + b.ix) % 3 = 0 AS main10
        FROM supplier, (VALUES (0, 'av1'), (1, 'hevc'), (2, 'h264')) c(ix, codec),
        (VALUES (0, 'nvenc'), (1, 'qsv'), (2, 'vaapi'), (3, 'amf'), (4, 'videotoolbox')) b(ix, backend)""",
    "requests": t.sql_select(t.REQUESTS, "lineitem"),
    "routed_base": t.sql_select(t.ROUTED, "library"),
    "codec_alias": """SELECT * FROM (VALUES ('h265', 'hevc', 'libx265'), ('hevc', 'hevc', 'libx265'),
        ('h264', 'h264', 'libx264'), ('avc', 'h264', 'libx264'), ('av1', 'av1', 'libsvtav1'),
        ('vp9', 'vp9', 'libvpx-vp9')) a(alias, probe_name, software)""",
    "routed": """SELECT r.*, CASE WHEN backend = '' THEN a.software ELSE a.probe_name || '_' || backend END AS encoder,
        CASE WHEN pix_fmt IN ('yuv420p', 'yuvj420p', 'nv12', 'nv21') THEN 8
             WHEN pix_fmt IN ('yuv420p10le', 'p010le') THEN 10 WHEN pix_fmt IS NOT NULL THEN 0 END AS surface_depth
        FROM routed_base r JOIN codec_alias a ON a.alias = r.codec""",
    "host_jobs": t.sql_select(t.HOST_JOBS, "supplier"),
    "usable": "SELECT *, CASE codec WHEN 'av1' THEN 0 WHEN 'hevc' THEN 1 ELSE 2 END AS place FROM capability WHERE works",
    "recoded": """SELECT j.* REPLACE (CASE WHEN hwaccel = 'auto' THEN coalesce((SELECT min_by(u.codec, place) FROM usable u
          WHERE u.host = j.host AND u.backend <> 'videotoolbox' AND place >= j.job_id % 3), j.codec) ELSE j.codec END AS codec) FROM host_jobs j""",
    "settled": """SELECT r.*, a.probe_name, a.software, coalesce(b.backend, '') AS job_backend, coalesce(b.main10, false) AS main10
        FROM recoded r JOIN codec_alias a ON a.alias = r.codec
        LEFT JOIN (SELECT host, codec, mode, min_by(backend, rank) AS backend, min_by(main10, rank) AS main10 FROM
          (SELECT host, codec, 'auto' AS mode, backend, main10, CASE backend WHEN 'nvenc' THEN 0 WHEN 'qsv' THEN 1 WHEN 'vaapi' THEN 2 ELSE 3 END AS rank
             FROM usable WHERE backend <> 'videotoolbox'
           UNION ALL SELECT host, codec, backend, backend, main10, 0 FROM usable) GROUP BY ALL) b
          ON b.host = r.host AND b.codec = a.probe_name AND b.mode = r.hwaccel""",
    "job_files": f"""SELECT s.file_id, s.path, s.stem, s.links, s.mtime, s.video_codec, s.dolby_vision, s.profile, s.pix_fmt,
          j.job_id, j.skip_text, j.codec, j.inplace, j.skip_hardlinked, j.allow_hdr_loss, j.hwdecode, j.main10, j.job_backend, j.probe_name, j.software,
          CASE WHEN pix_fmt IN ('yuv420p', 'nv12') THEN 8 WHEN pix_fmt = 'yuv420p10le' THEN 10 WHEN pix_fmt IS NOT NULL THEN 0 END AS depth,
          coalesce(j.job_backend <> '' AND s.pix_fmt <> '', false) AS known, dotted,
          CASE WHEN inplace THEN path ELSE regexp_replace(path, '\\.[^./]*$', '') || '.out'
            || CASE WHEN container = '' THEN dotted ELSE '.' || container END END AS output_path
        FROM stems s JOIN settled j ON j.job_id = s.file_id % 10
        WHERE list_contains(list_transform(string_split(lower(j.ext_text), ' '), lambda x: ltrim(x, '.')), s.ext)""",
    # planning
    "stems": """SELECT *, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^./]*$', '') AS stem,
        regexp_extract(path, '(\\.[^./]*)$', 1) AS dotted FROM library""",
    "verdicts": """SELECT backend, codec, profile, pix_fmt, CASE
          WHEN backend NOT IN ('nvenc', 'qsv', 'vaapi') THEN false
          WHEN outcome = 'positive' THEN true WHEN outcome = 'negative' THEN false END AS verdict
        FROM (SELECT *, row_number() OVER (PARTITION BY backend, codec, profile, pix_fmt ORDER BY seq DESC) AS rn
              FROM evidence WHERE outcome NOT IN ('timeout', 'cancel')) WHERE rn = 1""",
    "parsed_progress": """SELECT *,
          CAST(regexp_extract(line, 'time=(\\d{2}):(\\d{2}):(\\d{2})\\.(\\d{2})', 1) AS BIGINT) * 3600000
          + CAST(regexp_extract(line, 'time=(\\d{2}):(\\d{2}):(\\d{2})\\.(\\d{2})', 2) AS BIGINT) * 60000
          + CAST(regexp_extract(line, 'time=(\\d{2}):(\\d{2}):(\\d{2})\\.(\\d{2})', 3) AS BIGINT) * 1000
          + CAST(regexp_extract(line, 'time=(\\d{2}):(\\d{2}):(\\d{2})\\.(\\d{2})', 4) AS BIGINT) * 10 AS current_ms,
          CAST(regexp_extract(line, 'speed=\\s*([\\d.]+)x', 1) AS DOUBLE) AS speed
        FROM progress WHERE line LIKE '%time=%'""",
    "job_log": f"""SELECT run_id, source_path, seq, ts,
          CASE WHEN seq % 501 = 500 THEN 'done' WHEN seq % 701 = 700 THEN 'failed' ELSE 'running' END AS status,
          least(1.0::DOUBLE, current_ms::DOUBLE / {t.TOTAL_MS}::DOUBLE) AS pct, printf('%.2fx', speed) AS speed
        FROM parsed_progress WHERE user_id % 7 <> 0""",
    "job_state": """SELECT run_id, source_path, status, CASE WHEN status = 'running' THEN pct ELSE 1.0 END AS pct,
          CASE WHEN status = 'running' THEN speed ELSE '' END AS speed, ts AS updated_at
        FROM (SELECT *, row_number() OVER (PARTITION BY run_id, source_path
              ORDER BY (status <> 'running')::INT DESC, ts DESC, seq DESC) AS rn FROM job_log) WHERE rn = 1""",
    "closed": """SELECT r.run_id, r.name, r.status AS before,
          count(*) FILTER (WHERE j.status = 'done') AS ok,
          count(*) FILTER (WHERE j.status IN ('failed', 'running')) AS failed,
          count(*) FILTER (WHERE j.status IN ('skipped', 'queued')) AS skipped
        FROM runs r LEFT JOIN jobs j ON r.run_id = j.run_id GROUP BY ALL""",
    "raw_counts": """SELECT r.run_id, r.started_at, r.status AS run_status, r.name,
          count(*) FILTER (WHERE j.status = 'done') AS ok, count(*) FILTER (WHERE j.status = 'failed') AS failed,
          count(*) FILTER (WHERE j.status = 'skipped') AS skipped
        FROM runs r LEFT JOIN jobs j ON r.run_id = j.run_id GROUP BY ALL""",
    "builtin_profiles": """SELECT * FROM (VALUES
        ('web', 'Plays nearly everywhere: H.264 in MP4 that starts before it is loaded.', 'h264', 23, 'fast', 'aac', '160k', 'mp4', NULL, '-movflags +faststart'),
        ('web-hevc', 'H.265 in MP4, tagged hvc1 so that Apple players take it.', 'h265', 26, 'medium', 'aac', '160k', 'mp4', NULL, '-tag:v hvc1 -movflags +faststart'),
        ('archive', 'H.265 at a low CRF to keep for good; sound is copied.', 'h265', 18, 'slow', 'copy', NULL, NULL, NULL, NULL),
        ('av1', 'AV1: long to encode, least to store.', 'av1', 30, 'slow', 'opus', '128k', NULL, NULL, NULL),
        ('mobile', 'H.264 in MP4 scaled to 720 lines for small screens.', 'h264', 26, 'fast', 'aac', '96k', 'mp4', NULL, '-vf scale=-2:720 -movflags +faststart')
        ) p(name, description, codec, crf, preset, audio_codec, audio_bitrate, container, subs, extra_args)""",
    "profiles": """SELECT coalesce(u.name, b.name) AS name,
          coalesce(nullif(u.description, ''), b.description) AS description,
          coalesce(nullif(u.codec, ''), b.codec) AS codec, coalesce(u.crf, b.crf) AS crf,
          coalesce(nullif(u.preset, ''), b.preset) AS preset, coalesce(u.audio_codec, b.audio_codec) AS audio_codec,
          coalesce(u.audio_bitrate, b.audio_bitrate) AS audio_bitrate, coalesce(u.container, b.container) AS container,
          coalesce(u.subs, b.subs) AS subs, coalesce(u.extra_text, b.extra_args) AS extra_args,
          CASE WHEN u.name IS NULL THEN 'built-in' WHEN b.name IS NULL THEN 'config' ELSE 'overridden' END AS source
        FROM builtin_profiles b FULL JOIN user_profiles u ON b.name = u.name""",
    "settings": """SELECT j.job_id, j.owner, j.site, coalesce(j.profile, '') AS profile, p.name IS NOT NULL AS profile_known,
          coalesce(j.codec, nullif(p.codec, ''), 'h265') AS codec,
          coalesce(j.preset, nullif(e.preset, ''), c.preset, nullif(p.preset, ''), 'medium') AS preset,
          coalesce(nullif(coalesce(j.audio_codec, c.audio_codec, p.audio_codec, 'copy'), ''), 'copy') AS audio_codec,
          coalesce(p.audio_bitrate, '') AS audio_bitrate, coalesce(j.subs, p.subs, 'copy') AS subs,
          coalesce(nullif(e.hwaccel, ''), 'auto') AS hwaccel, coalesce(c.hwdecode, 'auto') AS hwdecode, '.out' AS suffix,
          coalesce(j.output_dir, '') AS output_dir,
          ltrim(coalesce(j.container, c.container, nullif(p.container, ''), ''), '.') AS container,
          coalesce(j.crf, e.crf, p.crf, 23) AS crf, coalesce(j.decode_threads, 0) AS decode_threads,
          coalesce(j.inplace, false) AS inplace, false AS force, false AS skip_hardlinked, false AS allow_hdr_loss,
          concat_ws(' ', nullif(p.extra_args, ''), nullif(j.extra_text, '')) AS extra_args,
          coalesce(replace(j.ext_text, ',', ' '), CASE WHEN e.ext <> '' THEN array_to_string(list_filter(list_transform(string_split(e.ext, ','), lambda x: trim(x)), lambda x: x <> ''), ' ') END,
            c.ext_text, 'mkv mp4 avi') AS ext,
          coalesce(j.skip_text, replace(nullif(e.skip_source_codecs, ''), ',', ' '), c.skip_text, '') AS skip_source_codecs
        FROM job_specs j LEFT JOIN env_layer e ON e.owner = j.owner LEFT JOIN config_layer c ON c.site = j.site
        LEFT JOIN profiles p ON p.name = j.profile""",
}

_NEEDS = {
    "probe_text": ["library"], "transcodes": ["library"], "listing": ["library"], "jobs": ["library"],
    "routed_base": ["library"], "routed": ["routed_base", "codec_alias"], "stems": ["library"],
    "usable": ["capability"], "recoded": ["host_jobs", "usable"], "settled": ["recoded", "codec_alias", "usable"],
    "job_files": ["stems", "settled"],
    "verdicts": ["evidence"], "parsed_progress": ["progress"], "job_log": ["parsed_progress"], "job_state": ["job_log"],
    "closed": ["runs", "jobs"], "raw_counts": ["runs", "jobs"], "profiles": ["builtin_profiles", "user_profiles"],
    "settings": ["job_specs", "env_layer", "config_layer", "profiles"],
}


def _with(views: list[str], body: str) -> str:
    """The query with the derived tables it uses, and those they use, in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        visit(view)
    heads = ", ".join(f"{name} AS ({_VIEWS[name]})" for name in ordered)
    return f"WITH {heads} {body}" if heads else body


_DECISION = """CASE WHEN reason IS NULL THEN 'todo' WHEN reason = 'dolby_vision' THEN 'blocked' ELSE 'skipped' END AS decision"""
_OWN = "(ends_with(stem, '.transcoded') OR ends_with(stem, '.out'))"

_ALONGSIDE = f"""alongside AS (SELECT *, CASE WHEN {_OWN} THEN 'own_output'
        WHEN EXISTS (SELECT 1 FROM listing x WHERE x.path = s.output_path) THEN 'output_exists'
        WHEN video_codec = 'av1' THEN 'source_denylist' WHEN dolby_vision THEN 'dolby_vision' END AS reason
      FROM (SELECT *, regexp_replace(path, '\\.[^./]*$', '') || '.out' || dotted AS output_path FROM stems) s)"""
_INPLACE_REASON = """CASE WHEN links > 1 THEN 'hardlinked'
        WHEN EXISTS (SELECT 1 FROM transcodes h WHERE h.source_path = l.path AND h.source_mtime = l.mtime AND h.status = 'done') THEN 'history_done'
        WHEN video_codec = 'hevc' THEN 'already_target' WHEN video_codec IN ('avc', 'h264') THEN 'source_denylist'
        WHEN dolby_vision THEN 'dolby_vision' END"""

_RULE_IX = """CASE WHEN video_codec <> 'hevc' AND height > 1080 THEN 0 WHEN ext = 'avi' THEN 1
        WHEN audio_codec <> 'aac' AND bitrate > 15000 THEN 2 WHEN duration < 600.5 THEN 3 ELSE 4 END"""


def _case(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


def _stored_rule(kind: str, number: str, what: str) -> str:
    """Outcome of a stored sample program; what = ix | cmd | args."""
    hit = {
        2: [("video_codec <> 'hevc'", 0, "transcode", "--codec h265"), ("true", 1, "skip", "")],
        3: [(f"height >= {number} * 100 AND ext = 'mkv'", 0, "check", "")],
        4: [(f"duration < {number} * 100 + 0.5", 0, "transcode", "--crf 20")],
    }
    arms = []
    for k, rules in hit.items():
        for test, ix, cmd, args in rules:
            value = {"ix": str(ix), "cmd": f"'{cmd}'", "args": f"'{args}'"}[what]
            arms.append(f"WHEN {kind} % 5 = {k} AND {test} THEN {value}")
    return f"CASE {' '.join(arms)} END"


_HEALTH = "(SELECT path, NOT probe_ok AS corrupt, CASE WHEN probe_ok THEN video_codec <> '' END AS has_video FROM library)"
_REPORT = """SELECT strftime(make_timestamp(completed_at * 1000000), '%Y-%m-%d %H:%M:%S') AS completed, status,
    encoder AS encoder_label, crf, CASE WHEN elapsed_ms < 1000 THEN '0s' WHEN elapsed_ms < 60000 THEN (elapsed_ms // 1000) || 's'
    ELSE (elapsed_ms // 60000) || 'm' || (elapsed_ms // 1000 % 60) || 's' END AS elapsed, source_path, completed_at FROM transcodes"""
_SAVED = "CAST(coalesce(sum(source_size - output_size) FILTER (WHERE status = 'done' AND output_size < source_size AND output_size > 0), 0) AS BIGINT) AS bytes_saved"

_NVENC = "CASE WHEN preset IN ('superfast') THEN 'fast' WHEN preset IN ('slow', 'veryslow') THEN 'slow' ELSE preset END"
_ROUTE = """routes AS (SELECT r.*, sw,
        CASE WHEN sw THEN a.software ELSE encoder END AS route_encoder, CASE WHEN sw THEN '' ELSE r.backend END AS route_backend,
        CASE WHEN known AND NOT sw AND lower(hwdecode) <> 'off' AND v.verdict THEN r.backend ELSE '' END AS decode_backend,
        CASE WHEN known AND NOT sw THEN surface_depth ELSE 0 END AS source_bit_depth,
        CASE WHEN NOT sw THEN preset WHEN r.codec = 'h265' THEN
            CASE WHEN preset IN ('superfast', 'medium', 'slow', 'veryslow') THEN preset ELSE 'medium' END
          WHEN preset = '6' THEN '6' ELSE '8' END AS route_preset
      FROM (SELECT *, coalesce(known AND (surface_depth = 0 OR (surface_depth = 10 AND NOT main10)), false) AS sw
            FROM (SELECT *, coalesce(backend <> '' AND probe_ok AND pix_fmt <> '', false) AS known FROM routed)) r
      JOIN codec_alias a ON a.alias = r.codec
      LEFT JOIN verdicts v ON v.backend = r.backend AND v.codec = r.video_codec AND v.profile = r.profile AND v.pix_fmt = r.pix_fmt)"""
_COMMAND = """'-hide_banner'
    || CASE WHEN decode_backend = 'nvenc' THEN ' -hwaccel cuda -hwaccel_output_format cuda'
         WHEN decode_backend = 'qsv' THEN ' -init_hw_device qsv=qsv:hw_any -hwaccel qsv -hwaccel_output_format qsv'
         WHEN decode_backend = 'vaapi' THEN ' -vaapi_device /dev/dri/renderD128 -hwaccel vaapi -hwaccel_output_format vaapi'
         ELSE CASE WHEN decode_threads > 0 THEN ' -threads ' || decode_threads ELSE '' END
           || CASE WHEN route_backend = 'vaapi' THEN ' -vaapi_device /dev/dri/renderD128'
                WHEN route_backend = 'qsv' THEN ' -init_hw_device qsv=qsv:hw_any' ELSE '' END END
    || ' -i ' || path || ' -map 0:v:0 -map 0:a' || CASE WHEN subs = 'drop' THEN ' -sn' ELSE ' -map 0:s? -c:s copy' END
    || CASE WHEN decode_backend = '' AND route_backend = 'vaapi' THEN
         CASE WHEN source_bit_depth = 10 THEN ' -vf format=p010,hwupload' ELSE ' -vf format=nv12,hwupload' END ELSE '' END
    || ' -c:v ' || route_encoder
    || CASE route_backend WHEN 'nvenc' THEN ' -rc vbr -cq ' || crf WHEN 'qsv' THEN ' -q:v ' || crf
         WHEN 'vaapi' THEN ' -rc_mode CQP -qp ' || crf WHEN 'amf' THEN ' -rc cqp -qp_i ' || crf || ' -qp_p ' || crf
         ELSE ' -crf ' || crf END
    || CASE WHEN route_backend <> '' AND source_bit_depth = 10 AND starts_with(route_encoder, 'hevc_') THEN ' -profile:v main10' ELSE '' END
    || CASE WHEN mapped = '' THEN '' ELSE ' -preset ' || mapped END
    || CASE WHEN audio_codec IN ('', 'copy') THEN ' -c:a copy' ELSE ' -c:a '
         || CASE lower(audio_codec) WHEN 'opus' THEN 'libopus' WHEN 'aac' THEN 'aac' ELSE audio_codec END
         || CASE WHEN audio_bitrate <> '' THEN ' -b:a ' || audio_bitrate ELSE '' END END
    || CASE WHEN lower(dotted) = '.mp4' THEN ' -movflags +faststart' || CASE WHEN codec = 'h265' THEN ' -tag:v hvc1' ELSE '' END ELSE '' END
    || CASE WHEN extra_text <> '' THEN ' ' || extra_text ELSE '' END || ' -y ' || working_path"""


def _mapped(backend: str, encoder: str, preset: str) -> str:
    return f"""CASE WHEN {preset} = '' THEN '' WHEN {backend} = 'nvenc' THEN {_NVENC.replace('preset', preset)}
        WHEN {backend} = 'qsv' THEN CASE WHEN {preset} = 'superfast' THEN 'veryfast' ELSE {preset} END
        WHEN {backend} <> '' THEN '' WHEN {encoder} = 'libx265' THEN {preset}
        WHEN {preset} = '6' THEN '6' WHEN {preset} = '8' THEN '8' WHEN {preset} = 'medium' THEN '6' WHEN {preset} = 'superfast' THEN '11'
        WHEN {preset} = 'slow' THEN '4' WHEN {preset} = 'veryslow' THEN '2' ELSE '' END"""


def _rule_line_sql() -> str:
    """Rule text taken apart with list functions."""
    valid = "['codec eq','codec ne','audio eq','audio ne','ext eq','ext ne','height gt','height lt','height ge','height le','width gt','width lt','bitrate gt','bitrate lt','duration gt','duration lt']"
    fields = "['codec','audio','ext','height','width','bitrate','duration']"
    return f"""
    , trimmed AS (SELECT file_id, trim(line) AS x FROM rule_text)
    , cut AS (SELECT *, starts_with(x, 'when ') AS c, instr(x, ' do ') AS d FROM trimmed)
    , parts AS (SELECT *,
        CASE WHEN c AND d > 0 THEN list_transform(string_split(substr(x, 6, d - 6), ' and '), lambda p: string_split(trim(p), ' ')) ELSE [] END AS clauses,
        CASE WHEN c AND d > 0 THEN trim(substr(x, d + 4)) WHEN NOT c AND starts_with(x, 'do ') THEN trim(substr(x, 4)) END AS act FROM cut)
    , problems AS (SELECT *, list_filter(list_transform(clauses, lambda w: CASE WHEN len(w) <> 3 THEN 'bad_condition'
        WHEN NOT list_contains({fields}, w[1]) THEN 'unknown_field'
        WHEN NOT list_contains({valid}, w[1] || ' ' || w[2]) THEN 'invalid_op' END), lambda e: e IS NOT NULL) AS wrong FROM parts)
    , judged AS (SELECT *, CASE WHEN c AND d = 0 THEN 'missing_do' WHEN len(wrong) > 0 THEN wrong[1]
        WHEN act IS NULL THEN 'expected_do' WHEN act = '' THEN 'missing_action' END AS error FROM problems)
    SELECT file_id, CASE WHEN error IS NULL THEN CAST(len(clauses) AS INT) END AS conditions,
        CASE WHEN error IS NULL THEN x END AS rule,
        CASE WHEN error IS NULL THEN string_split(act, ' ')[1] END AS cmd,
        CASE WHEN error IS NULL THEN array_to_string(string_split(act, ' ')[2:], ' ') END AS args, error FROM judged"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    def add(name: str, views: list[str], body: str, ctes: str = "") -> None:
        head = _with(views, "")
        sql[name] = f"{head}{', ' if head and ctes else ('WITH ' if ctes else '')}{ctes} {body}"

    add("inventory_filter", ["library"], "SELECT file_id, path, ext, size, mtime, links FROM library WHERE ext IN ('mkv', 'mp4')")
    add("inventory_read", ["library"], "SELECT path, ext, size, mtime, links FROM library WHERE ext IN ('mkv', 'mp4')")
    add("probe_read", ["library"], """SELECT path, probe_ok, video_codec, audio_codec, height,
        CASE WHEN probe_ok THEN CASE WHEN file_id % 23 = 0 THEN 0 WHEN file_id % 37 = 0 THEN 1000000000000000 ELSE bitrate END END AS bitrate FROM library""")
    add("inventory_live", ["tree"], """SELECT f.rel_path, regexp_extract(lower(f.rel_path), '([^.]*)$', 1) AS ext, CAST(bytes AS BIGINT) AS size, mtime,
        CASE WHEN hard_link IS NULL THEN 1 ELSE 2 END::BIGINT AS links, is_symlink
        FROM (SELECT *, false AS is_symlink FROM tree UNION ALL SELECT * REPLACE (symlink AS rel_path), true FROM tree WHERE symlink IS NOT NULL
              UNION ALL SELECT * REPLACE (hard_link AS rel_path), false FROM tree WHERE hard_link IS NOT NULL) f WHERE regexp_matches(f.rel_path, '\\.(mkv|mp4)$', 'i')""")
    add("each_path", ["library"], "SELECT path FROM library WHERE ext IN ('mkv', 'mp4', 'avi')")
    add("probe_attrs", ["library"], """SELECT file_id, path, probe_ok, video_codec, audio_codec,
        CASE WHEN probe_ok THEN profile END AS profile, pix_fmt,
        CASE WHEN pix_fmt = '' THEN 0 WHEN pix_fmt LIKE '%10le' THEN 10 WHEN pix_fmt IS NOT NULL THEN 8 END AS bit_depth,
        height, width, CASE WHEN probe_ok THEN CASE WHEN file_id % 23 = 0 THEN 0 WHEN file_id % 37 = 0 THEN 1000000000000000 ELSE bitrate END END AS bitrate,
        CASE WHEN probe_ok THEN CASE WHEN file_id % 19 = 0 THEN 0.0::DOUBLE ELSE duration + 0.5 END END AS duration,
        CASE WHEN pix_fmt IN ('yuv420p', 'nv12') THEN 8 WHEN pix_fmt = 'yuv420p10le' THEN 10 WHEN pix_fmt IS NOT NULL THEN 0 END AS surface_depth,
        dolby_vision FROM library""")
    add("health_report", ["library"], f"""SELECT count(*) AS files, count(*) FILTER (WHERE corrupt) AS corrupt,
        count(*) FILTER (WHERE NOT has_video) AS no_video, count(*) FILTER (WHERE corrupt) = 0 AS healthy FROM {_HEALTH}""")
    add("unhealthy_files", ["library"], f"SELECT path, CASE WHEN corrupt THEN 'corrupt' ELSE 'no_video' END AS problem FROM {_HEALTH} WHERE corrupt OR NOT has_video")
    add("format_depths", ["library"], """SELECT file_id,
        CASE pix_fmt WHEN '' THEN 0 WHEN 'yuv420p10le' THEN 10 WHEN 'yuv422p10le' THEN 10 ELSE CASE WHEN pix_fmt IS NOT NULL THEN 8 END END AS bit_depth,
        CASE pix_fmt WHEN 'yuv420p' THEN 8 WHEN 'nv12' THEN 8 WHEN 'yuv420p10le' THEN 10 ELSE CASE WHEN pix_fmt IS NOT NULL THEN 0 END END AS surface_depth FROM library""")
    tests = {
        "height_long": "height < 1080", "bitrate_long": "bitrate < 1000000000000000000",
        "codec_eq": "video_codec = 'hevc'", "codec_ne": "video_codec <> 'hevc'", "audio_eq": "audio_codec = 'aac'", "audio_ne": "audio_codec <> 'aac'",
        "ext_eq": "ext = 'mp4'", "ext_ne": "ext <> 'mp4'", "height_gt": "height > 720", "height_lt": "height < 720", "height_ge": "height >= 720",
        "height_le": "height <= 720", "width_gt": "width > 1280", "width_lt": "width < 1280", "bitrate_gt": "bitrate > 10000",
        "bitrate_lt": "bitrate < 10000", "duration_gt": "duration > 3600", "duration_lt": "duration < 3600",
    }
    listed = ", ".join(f"coalesce({test}, false) AS {name}" for name, test in tests.items())
    add("rule_match", ["library"], f"SELECT file_id, {listed}, true AS always FROM library")
    cmds, args = ["transcode", "transcode", "check", "check", "skip"], ["--codec h265 --crf 24", "--codec h264", "", "", ""]
    outcomes = ["tracked", "tracked", "untracked", "untracked", "skipped"]
    decided = f"(SELECT file_id, {_RULE_IX} AS rule_ix FROM library)"
    add("rule_program", ["library"], f"SELECT file_id, rule_ix, {_case('rule_ix', cmds)} AS cmd, {_case('rule_ix', args)} AS args, {_case('rule_ix', outcomes)} AS outcome FROM {decided}")
    add("rule_counts", ["library"], f"SELECT rule_ix, {_case('rule_ix', cmds)} AS cmd, count(*) AS files FROM {decided} GROUP BY ALL")
    stored = lambda what: _stored_rule("c_custkey", "c_nationkey", what)
    add("rule_program_stored", ["library"], f"SELECT file_id, {stored('ix')} AS rule_ix, {stored('cmd')} AS cmd, {stored('args')} AS args FROM library JOIN customer ON c_custkey = owner")
    add("program_list", ["programs"], """SELECT id, name, schedule, src, replace(CASE WHEN ext = '' THEN 'mkv,mp4,avi' ELSE ext END, ',', '|') AS ext,
        CASE WHEN rules_json IN ('', '[]') THEN 0 ELSE CAST(json_array_length(rules_json::JSON) AS INT) END AS n_rules,
        CASE WHEN rules_json NOT IN ('', '[]') THEN json_extract_string(rules_json::JSON, '$[0].do.cmd') END AS first_cmd, false AS rules_corrupt FROM programs""")
    add("rule_violations", [], f"""SELECT CAST(p_partkey AS STRING) AS id, 0 AS rule_ix, 0 AS cond_ix, field, op, '1' AS value,
        CASE WHEN v.ops IS NULL THEN 'unknown_field' ELSE 'invalid_op' END AS problem, array_to_string(v.ops, ', ') AS valid_ops
        FROM (SELECT p_partkey, {t.DRAFT_FIELD} AS field, {t.DRAFT_OP} AS op FROM part) d
        LEFT JOIN (VALUES ('codec', ['eq', 'ne']), ('audio', ['eq', 'ne']), ('ext', ['eq', 'ne']), ('height', ['ge', 'gt', 'le', 'lt']),
          ('width', ['gt', 'lt']), ('bitrate', ['gt', 'lt']), ('duration', ['gt', 'lt'])) v(name, ops) ON v.name = d.field
        WHERE v.ops IS NULL OR NOT list_contains(v.ops, op)""")
    add("program_violations", [], f"""SELECT CAST(p_partkey AS STRING) AS id, CAST(NULL AS INTEGER) AS rule_ix, CAST(NULL AS INTEGER) AS cond_ix, 'missing_src' AS problem
        FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 7 = 1
        UNION ALL SELECT id, rule_ix, cond_ix, problem FROM ({sql["rule_violations"]})""")
    both = "'when height gt ' || script_id || ' and codec ne hevc do transcode --crf 20; do skip'"
    add("manifest_programs", [], f"""SELECT script_id, CASE WHEN kind IN (0, 1, 3, 4, 6, 7) THEN '' ELSE c_name END AS name,
        CASE WHEN kind > 7 THEN '0 ' || (script_id % 24) || ' * * *' ELSE '' END AS schedule,
        CASE WHEN kind IN (0, 1, 2, 6, 7) THEN '' ELSE '/lib/' || c_nationkey END AS src,
        CASE WHEN kind = 5 THEN '.MP4|avi' WHEN kind > 7 THEN 'mkv|mp4' ELSE 'mkv|mp4|avi' END AS ext,
        CASE WHEN kind IN (2, 3) OR kind > 7 THEN {both} ELSE '' END AS rules,
        CASE kind WHEN 3 THEN 3 WHEN 4 THEN 3 WHEN 5 THEN 0 ELSE CASE WHEN kind > 7 THEN 0 ELSE 1 END END AS n_errors
        FROM (SELECT c_custkey AS script_id, c_custkey % 12 AS kind, c_name, c_nationkey FROM customer)""")
    add("manifest_errors", [], """SELECT c_custkey AS script_id, line_no, error, text FROM customer JOIN (VALUES
        (0, NULL, 'no_block', NULL), (1, NULL, 'block_not_closed', NULL), (2, NULL, 'missing_src', NULL), (3, 5, 'invalid_op', 'when codec gt hevc do transcode'),
        (3, 8, 'unknown_field', 'when size eq 1 do skip'), (3, 9, 'expected_do', 'do'), (4, 3, 'missing_do', 'when codec ne hevc transcode'),
        (4, 4, 'bad_condition', 'when codec ne do skip'), (4, 5, 'expected_do', 'transcode'), (6, NULL, 'missing_src', NULL), (7, NULL, 'no_block', NULL)
        ) e(kind, line_no, error, text) ON c_custkey % 12 = kind""")
    add("manifest_round_trip", ["programs"], """SELECT id, name, schedule, src, CASE WHEN ext = '' THEN 'mkv|mp4|avi' ELSE replace(ext, ',', '|') END AS ext,
        CASE CAST(id AS BIGINT) % 5 WHEN 2 THEN 'when codec ne hevc do transcode --codec h265; do skip'
          WHEN 3 THEN 'when height ge ' || (c_nationkey * 100) || ' and ext eq MKV do check'
          WHEN 4 THEN 'when duration lt ' || (c_nationkey * 100) || '.5 do transcode --crf 20; when bitrate gt fast do check' ELSE '' END AS rules, 0 AS n_errors
        FROM programs JOIN customer ON CAST(c_custkey AS STRING) = id""")
    add("rule_lines", ["rule_text"], _rule_line_sql().lstrip())
    region = lambda what: _stored_rule("(r_regionkey + 2)", "(r_regionkey * 4)", what)
    add("program_assign", ["library"], f"""SELECT file_id, CAST(r_regionkey AS STRING) AS program_id, {region('ix')} AS rule_ix, {region('cmd')} AS cmd,
        CASE {region('cmd')} WHEN 'transcode' THEN 'tracked' WHEN 'check' THEN 'untracked' ELSE 'skipped' END AS outcome
        FROM library JOIN region ON starts_with(path, CASE r_regionkey WHEN 0 THEN '/lib/f/' WHEN 1 THEN '/lib/o/' WHEN 2 THEN '/lib/' WHEN 3 THEN '/' ELSE '/lib/p/' END)
          AND list_contains(CASE r_regionkey % 3 WHEN 0 THEN ['mkv', 'mp4'] WHEN 1 THEN ['mkv', 'mp4', 'avi'] ELSE ['avi', 'mkv'] END, ext)""")

    add("plan_alongside", ["stems", "listing"], f"SELECT file_id, output_path, {_DECISION}, reason FROM alongside", _ALONGSIDE)
    add("plan_mirrored", ["stems", "listing"], f"""SELECT file_id, output_path, {_DECISION}, reason FROM
        (SELECT *, CASE WHEN {_OWN} THEN 'own_output' WHEN EXISTS (SELECT 1 FROM listing x WHERE x.path = s.output_path) THEN 'output_exists' END AS reason
         FROM (SELECT *, '/out/' || regexp_replace(rel_path, '\\.[^./]*$', '') || '.mp4' AS output_path FROM stems) s)""")
    add("plan_inplace", ["library", "transcodes"], f"SELECT file_id, path AS output_path, {_DECISION}, reason FROM (SELECT *, {_INPLACE_REASON} AS reason FROM library l)")
    add("plan_force", ["stems"], f"""SELECT file_id, inplace, output_path, {_DECISION}, reason FROM
        (SELECT file_id, false AS inplace, regexp_replace(path, '\\.[^./]*$', '') || '.out' || dotted AS output_path,
           CASE WHEN {_OWN} THEN 'own_output' WHEN video_codec = 'av1' THEN 'source_denylist' WHEN dolby_vision THEN 'dolby_vision' END AS reason FROM stems
         UNION ALL SELECT file_id, true, path, CASE WHEN dolby_vision THEN 'dolby_vision' END FROM stems)""")
    add("plan_summary", ["stems", "listing"], f"SELECT decision, reason, count(*) AS files FROM (SELECT {_DECISION}, reason FROM alongside) GROUP BY ALL", _ALONGSIDE)
    add("plan_listing", ["stems", "listing"], "SELECT path AS src, output_path AS dst, regexp_replace(path, '[^/]*$', '') || stem || '.transcoded' || dotted AS working, 'h265' AS codec, 23 AS crf FROM alongside WHERE reason IS NULL", _ALONGSIDE)
    add("orphans", ["listing"], "SELECT path FROM listing WHERE regexp_matches(path, '\\.transcoded\\.(mkv|mp4|avi)$', 'i')")

    add("codec_aliases", ["requests", "codec_alias"], """SELECT request_id, line, part, codec, audio_codec, coalesce(probe_name, '') AS codec_name,
        coalesce(software, codec) AS software_encoder,
        CASE lower(audio_codec) WHEN 'opus' THEN 'libopus' WHEN 'mp3' THEN 'libmp3lame' ELSE audio_codec END AS audio_encoder
        FROM (SELECT *, CASE part % 4 WHEN 0 THEN 'copy' WHEN 1 THEN 'OPUS' WHEN 2 THEN 'mp3' ELSE 'libfdk_aac' END AS audio_codec FROM requests)
        LEFT JOIN codec_alias ON alias = lower(codec)""")
    add("profile_overlay", ["profiles"], "SELECT * FROM profiles")
    add("profile_catalog", ["profiles"], "SELECT name, source, coalesce(codec, '-') AS codec, coalesce(CAST(crf AS STRING), '-') AS crf, coalesce(description, '-') AS description FROM profiles")
    add("settings_resolve", ["settings"], "SELECT * FROM settings")
    problems = {
        "inplace_with_output_dir": "inplace AND output_dir <> ''", "inplace_with_container": "inplace AND container <> ''",
        "unknown_profile": "profile <> '' AND NOT profile_known", "unknown_codec": "lower(codec) NOT IN ('h265', 'hevc', 'h264', 'avc', 'av1', 'vp9')",
        "crf_out_of_range": "crf < 0 OR crf > 51", "negative_decode_threads": "decode_threads < 0",
        "unknown_hwaccel": "hwaccel NOT IN ('auto', 'none', 'nvenc')", "unknown_hwdecode": "hwdecode NOT IN ('auto', 'off')",
        "unknown_audio_codec": "audio_codec NOT IN ('copy', 'aac', 'opus', 'mp3', 'ac3', 'flac')", "unknown_subs": "subs NOT IN ('copy', 'drop')",
    }
    add("settings_violations", ["settings"], " UNION ALL ".join(f"SELECT job_id, '{p}' AS problem FROM settings WHERE {test}" for p, test in problems.items()))
    add("preset_resolve", ["routed"], f"""SELECT file_id, backend, encoder, preset, {_mapped('backend', 'encoder', 'preset')} AS encoder_preset, d AS default_preset,
        CASE WHEN (backend = 'nvenc' AND preset IN ('p5')) OR (backend = 'qsv' AND preset IN ('medium', 'slow', 'veryslow'))
               OR (encoder = 'libx265' AND preset IN ('superfast', 'medium', 'slow', 'veryslow')) OR (encoder = 'libsvtav1' AND preset = '6') THEN preset ELSE d END AS valid_preset
        FROM (SELECT *, CASE WHEN backend = 'nvenc' THEN 'p5' WHEN backend = 'qsv' THEN 'medium' WHEN encoder = 'libx265' THEN 'medium' WHEN encoder = 'libsvtav1' THEN '8' ELSE '' END AS d FROM routed)""")

    add("encoder_pick", ["requests", "capability", "codec_alias"], """SELECT request_id, line, part, host, codec, hwaccel,
        CASE WHEN b IS NULL THEN coalesce(software, codec) ELSE probe_name || '_' || b END AS encoder, coalesce(b, '') AS backend
        FROM (SELECT r.*, a.software, a.probe_name, CASE
            WHEN lower(hwaccel) = 'auto' THEN (SELECT min_by(backend, CASE backend WHEN 'nvenc' THEN 0 WHEN 'qsv' THEN 1 WHEN 'vaapi' THEN 2 ELSE 3 END)
                FROM capability c WHERE c.host = r.host AND c.codec = a.probe_name AND works AND backend <> 'videotoolbox')
            WHEN hwaccel IN ('', 'none') THEN NULL
            ELSE (SELECT max(backend) FROM capability c WHERE c.host = r.host AND c.codec = a.probe_name AND works AND backend = lower(r.hwaccel)) END AS b
          FROM requests r LEFT JOIN codec_alias a ON a.alias = lower(r.codec))""")
    add("codec_pick", ["requests", "capability", "codec_alias"], """SELECT request_id, line, part, host, codec, hwaccel,
        CASE WHEN lower(hwaccel) = 'auto' AND probe_name IN ('av1', 'hevc', 'h264') THEN coalesce((SELECT min_by(codec, place) FROM usable u
          WHERE u.host = r.host AND u.place >= CASE probe_name WHEN 'av1' THEN 0 WHEN 'hevc' THEN 1 ELSE 2 END), codec) ELSE codec END AS resolved_codec
        FROM (SELECT * FROM requests LEFT JOIN codec_alias ON alias = lower(codec)) r""",
        "usable AS (SELECT DISTINCT host, codec, CASE codec WHEN 'av1' THEN 0 WHEN 'hevc' THEN 1 ELSE 2 END AS place FROM capability WHERE works AND backend <> 'videotoolbox')")
    add("shape_worklist", ["routed", "verdicts"], """SELECT backend, video_codec AS codec, profile, pix_fmt, min(path) AS sample_path, count(*) AS files FROM routed r
        WHERE probe_ok AND backend IN ('nvenc', 'qsv', 'vaapi') AND upper(hwdecode) <> 'OFF'
          AND (pix_fmt IN ('yuv420p', 'nv12') OR (pix_fmt = 'yuv420p10le' AND main10))
          AND NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.backend = r.backend AND v.codec = r.video_codec AND v.profile = r.profile
            AND v.pix_fmt = r.pix_fmt AND v.verdict IS NOT NULL)
        GROUP BY ALL""")
    add("shape_verdict", ["verdicts"], "SELECT * FROM verdicts")
    add("encoder_verdict", ["evidence"], "SELECT DISTINCT backend, codec, true AS works FROM evidence WHERE outcome = 'positive'")
    add("decode_route", ["routed", "verdicts"], "SELECT file_id, route_encoder, route_backend, decode_backend, source_bit_depth, route_preset FROM routes", _ROUTE)
    add("resource_profile", ["routed"], """SELECT file_id, hw AS decode_hw, backend <> '' AND NOT hw AS warn,
        CASE WHEN hw THEN 'hw: ' || backend || ' (per-file, may fall back)' WHEN decode_threads = 1 THEN 'software (capped at 1 thread)'
          WHEN decode_threads > 1 THEN 'software (capped at ' || decode_threads || ' threads)' ELSE 'software (uncapped)' END AS decode_label
        FROM (SELECT *, backend IN ('nvenc', 'qsv', 'vaapi') AND lower(hwdecode) <> 'off' AS hw FROM routed)""")
    add("command_manifest", ["routed", "verdicts"], f"""SELECT file_id, working_path, {_COMMAND} AS command FROM
        (SELECT *, {_mapped('route_backend', 'route_encoder', 'route_preset')} AS mapped, regexp_extract(path, '(\\.[^./]*)$', 1) AS dotted,
          regexp_replace(path, '\\.[^./]*$', '') || '.transcoded' || regexp_extract(path, '(\\.[^./]*)$', 1) AS working_path FROM routes)""", _ROUTE)

    add("library_run", ["codec_alias", "job_files", "transcodes", "listing", "verdicts"], f"""SELECT file_id, job_id, codec, output_path, {_DECISION}, reason,
        CASE WHEN sw OR job_backend = '' THEN software ELSE probe_name || '_' || job_backend END AS encoder,
        CASE WHEN sw THEN '' ELSE job_backend END AS backend,
        CASE WHEN known AND NOT sw AND hwdecode = 'auto' AND verdict THEN job_backend ELSE '' END AS decode_backend,
        CASE WHEN known AND NOT sw THEN depth ELSE 0 END AS source_bit_depth,
        CASE WHEN reason IS NULL THEN regexp_replace(path, '[^/]*$', '') || stem || '.transcoded' || regexp_extract(output_path, '(\\.[^./]*)$', 1) END AS last_arg
        FROM (SELECT f.*, v.verdict, known AND (depth = 0 OR (depth = 10 AND NOT main10)) AS sw, coalesce(CASE
            WHEN inplace THEN CASE WHEN skip_hardlinked AND links > 1 THEN 'hardlinked'
              WHEN EXISTS (SELECT 1 FROM transcodes h WHERE h.source_path = f.path AND h.source_mtime = f.mtime AND h.status = 'done') THEN 'history_done'
              WHEN f.video_codec = probe_name THEN 'already_target' END
            WHEN {_OWN} THEN 'own_output'
            WHEN EXISTS (SELECT 1 FROM listing x WHERE x.path = f.output_path) THEN 'output_exists' END,
            CASE WHEN f.video_codec IN (SELECT coalesce(a.probe_name, i.item) FROM (SELECT unnest(string_split(lower(f.skip_text), ' ')) AS item) i
              LEFT JOIN codec_alias a ON a.alias = i.item) AND f.video_codec <> '' THEN 'source_denylist' END,
            CASE WHEN dolby_vision AND NOT allow_hdr_loss THEN 'dolby_vision' END) AS reason
          FROM job_files f LEFT JOIN verdicts v ON v.backend = f.job_backend AND v.codec = f.video_codec AND v.profile = f.profile AND v.pix_fmt = f.pix_fmt)""")
    add("run_register", ["stems", "listing"], "SELECT 'run-1' AS run_id, path AS source_path, 'queued' AS status, 0.0::DOUBLE AS pct, '' AS speed, 1000000000::BIGINT AS ts, (-1)::BIGINT AS seq FROM alongside WHERE reason IS NULL", _ALONGSIDE)
    add("run_start", ["stems", "listing"], """SELECT 'run-1' AS run_id, 'nightly' AS name, 'transcode' AS run_kind, 'running' AS event, count(*) AS total,
        0::BIGINT AS ok, 0::BIGINT AS failed, 0::BIGINT AS skipped, 1000000000::BIGINT AS at FROM alongside WHERE reason IS NULL""", _ALONGSIDE)
    add("progress_parse", ["parsed_progress"], f"""SELECT seq, run_id, source_path, current_ms, {t.TOTAL_MS}::BIGINT AS total_ms, speed,
        least(1.0::DOUBLE, current_ms::DOUBLE / {t.TOTAL_MS}::DOUBLE) AS pct, eta_ms,
        CASE WHEN eta_ms <= 0 THEN '--' WHEN r >= 3600 THEN (r // 3600) || 'h' || lpad(CAST(r % 3600 // 60 AS STRING), 2, '0') || 'm'
          WHEN r >= 60 THEN (r // 60) || 'm' || lpad(CAST(r % 60 AS STRING), 2, '0') || 's' ELSE r || 's' END AS eta
        FROM (SELECT *, (eta_ms + 500) // 1000 AS r FROM (SELECT *, CASE WHEN current_ms < {t.TOTAL_MS} AND speed > 0
          THEN CAST(floor(({t.TOTAL_MS} - current_ms)::DOUBLE / speed) AS BIGINT) ELSE 0 END AS eta_ms FROM parsed_progress))""")
    add("progress_split", ["progress"], """SELECT seq, 0 AS line_no, line FROM progress UNION ALL SELECT seq, 1, line FROM progress
        UNION ALL SELECT seq, 2, '' FROM progress UNION ALL SELECT seq, 3, 'press q' FROM progress""")
    add("job_latest", ["job_state"], "SELECT * FROM job_state")
    add("run_reconcile", ["closed"], """SELECT run_id, name, CASE WHEN before = 'cancelled' THEN before WHEN failed > 0 THEN 'failed' ELSE 'done' END AS status,
        CASE WHEN before = 'cancelled' THEN 0 ELSE ok END AS ok, CASE WHEN before = 'cancelled' THEN 0 ELSE failed END AS failed,
        CASE WHEN before = 'cancelled' THEN 0 ELSE skipped END AS skipped FROM closed""")
    add("run_finish", ["raw_counts"], "SELECT run_id, CASE WHEN failed > 0 THEN 'failed' ELSE 'done' END AS event, ok, failed, skipped, 1000000000::BIGINT AS at FROM raw_counts")
    add("run_ledger", ["raw_counts"], """SELECT CAST(run_id AS VARCHAR) AS run_id, name, 'program' AS run_kind, started_at,
        CASE run_status WHEN 'cancelled' THEN 1000000000 WHEN 'running' THEN NULL ELSE started_at + 50 END AS finished_at,
        CASE WHEN run_status IN ('cancelled', 'running') THEN run_status WHEN failed > 0 THEN 'failed' ELSE 'done' END AS status, run_id % 17 AS total,
        CASE WHEN run_status IN ('cancelled', 'running') THEN 0 ELSE ok END AS ok, CASE WHEN run_status IN ('cancelled', 'running') THEN 0 ELSE failed END AS failed,
        CASE WHEN run_status IN ('cancelled', 'running') THEN 0 ELSE skipped END AS skipped FROM raw_counts""")
    add("recent_runs", ["runs"], "SELECT run_id, name, started_at, status FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 50")
    add("recent_failed_runs", ["runs"], "SELECT run_id, name, started_at, status FROM runs WHERE status = 'failed' ORDER BY started_at DESC, run_id DESC LIMIT 10")
    add("active_runs", ["runs"], "SELECT run_id, name, started_at FROM runs WHERE status = 'running'")
    add("run_detail", ["runs", "jobs"], """SELECT r.run_id, r.name, r.status, j.source_path, j.status AS job_status, j.pct AS job_pct, j.updated_at AS job_updated_at
        FROM runs r LEFT JOIN jobs j ON r.run_id = j.run_id""")
    add("run_documents", ["runs", "jobs"], """SELECT r.run_id, coalesce(page, 0) AS page, CAST(count(source_path) AS INT) AS n_jobs,
        coalesce(string_agg(source_path || '=' || job_status, ';' ORDER BY source_path), '') AS jobs FROM runs r LEFT JOIN paged p ON r.run_id = p.run_id GROUP BY r.run_id, page""",
        """paged AS (SELECT run_id, source_path, status AS job_status,
          CAST(('0x' || substr(md5(source_path), 1, 8)) AS BIGINT) % CAST(ceil(count(*) OVER (PARTITION BY run_id) / 8.0) AS BIGINT) AS page FROM jobs)""")
    earned = "status = 'failed' AND error_kind = 'exec' AND decode_backend <> '' AND NOT cancelled"
    add("attempts_final", ["transcodes"], f"""SELECT source_path, max(n) AS attempts, max(status) FILTER (WHERE last = 1) AS status,
        bool_or({earned}) FILTER (WHERE first = 1) AS retry_earned, bool_or({earned}) FILTER (WHERE first = 1) AND max(n) = 1 AS retry_due
        FROM (SELECT *, count(*) OVER (PARTITION BY source_path) AS n,
          row_number() OVER (PARTITION BY source_path ORDER BY completed_at, l_linenumber, l_partkey, l_suppkey) AS first,
          row_number() OVER (PARTITION BY source_path ORDER BY completed_at DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS last FROM transcodes)
        GROUP BY source_path""")
    add("retry_evictions", ["transcodes"], f"SELECT decode_backend AS backend, video_codec AS codec, profile, pix_fmt, completed_at AS seq, 'evict' AS outcome FROM transcodes WHERE {earned}")
    add("exit_outcome", ["closed"], """SELECT run_id, total, failed, CASE WHEN failed = 0 THEN 0 WHEN failed = total THEN 4 ELSE 3 END AS exit_code FROM
        (SELECT run_id, CASE WHEN before = 'cancelled' THEN 0 ELSE failed END AS failed, CASE WHEN before = 'cancelled' THEN 0 ELSE ok + failed END AS total FROM closed)""")
    add("queue_counters", ["runs", "jobs"], """SELECT j.run_id, count(*) FILTER (WHERE j.status = 'done') AS done,
        count(*) FILTER (WHERE j.status = 'failed' AND NOT coalesce(updated_at >= cancelled_at, false)) AS errors,
        count(*) FILTER (WHERE j.status = 'failed' AND updated_at >= cancelled_at) AS cancelled,
        count(*) FILTER (WHERE j.status = 'running') AS active, count(*) FILTER (WHERE j.status = 'queued') AS pending,
        count(*) FILTER (WHERE j.status = 'skipped') AS skipped FROM jobs j LEFT JOIN runs r ON r.run_id = j.run_id GROUP BY j.run_id""")
    add("stalled_runs", ["runs", "jobs"], """SELECT run_id, last_update FROM (SELECT r.run_id, coalesce(max(updated_at), r.started_at) AS last_update
        FROM runs r LEFT JOIN jobs j ON r.run_id = j.run_id WHERE r.status = 'running' GROUP BY r.run_id, r.started_at) WHERE last_update < 1000000000 - 80000000""")

    order = "ORDER BY completed_at DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey"
    add("recent_history", ["transcodes"], f"{_REPORT} {order} LIMIT 20")
    add("recent_history_stored", ["transcodes"], _REPORT.replace("source_path, completed_at", "source_path, completed_at, source_size, output_size")
        + " ORDER BY completed_at DESC, source_path, source_size, crf, elapsed_ms, output_size LIMIT 20")
    add("recent_failed", ["transcodes"], f"{_REPORT} WHERE status = 'failed' {order} LIMIT 50")
    add("space_saved", ["transcodes"], f"SELECT {_SAVED} FROM transcodes")
    add("savings_rollup", ["transcodes"], f"SELECT encoder, target_codec, CAST(grouping(encoder, target_codec) AS INT) AS level, count(*) AS attempts, {_SAVED} FROM transcodes GROUP BY ROLLUP (encoder, target_codec)")
    add("savings_by_day", ["transcodes"], f"SELECT encoder, target_codec, strftime(make_timestamp(completed_at * 1000000), '%Y-%m-%d') AS day, count(*) AS attempts, {_SAVED} FROM transcodes GROUP BY ALL")
    add("history_display", ["transcodes"], f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, completed, elapsed, encoder_label FROM ({_REPORT.replace('source_path, completed_at', 'l_orderkey, l_linenumber, l_partkey, l_suppkey')})")
    add("error_tail", ["transcodes"], "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, right(error_msg, 200) AS tail FROM transcodes")
    add("history_append", ["transcodes"], """SELECT strftime(make_timestamp(completed_at * 1000000), '%Y-%m') AS completed_month, status, count(*) AS attempts,
        CAST(sum(source_size) AS BIGINT) AS source_bytes, CAST(sum(least(length(error_msg), 200)) AS BIGINT) AS error_chars, count(*) AS no_codec FROM transcodes GROUP BY ALL""")
    add("job_events_append", ["job_state"], "SELECT CAST(run_id AS STRING) AS run_id, source_path, status, pct, speed, updated_at FROM job_state")

    add("changed_files_stream", ["library"], """SELECT file_id, mtime, seen_at, CASE WHEN before IS NULL THEN 'new' ELSE 'changed' END AS change
        FROM (SELECT *, lag(mtime) OVER (PARTITION BY file_id ORDER BY seen_at) AS before FROM snapshots) WHERE before IS NULL OR before <> mtime""",
        """snapshots AS (SELECT file_id, s.n::BIGINT AS seen_at, mtime + CASE WHEN file_id % 20 = 1 AND s.n >= 1 THEN 100 ELSE 0 END
            + CASE WHEN file_id % 60 = 1 AND s.n = 2 THEN 50 ELSE 0 END AS mtime
          FROM library, (VALUES (0), (1), (2)) s(n) WHERE s.n > 0 OR file_id % 10 <> 3)""")
    first = "CASE WHEN video_codec = 'hevc' THEN 'already_target' WHEN dolby_vision THEN 'dolby_vision' END"
    add("watch_twice", ["library", "transcodes"], f"""SELECT file_id, pass, mtime, {_DECISION}, reason FROM (
        SELECT file_id, pass, mtime, CASE
            WHEN EXISTS (SELECT 1 FROM transcodes h WHERE h.source_path = s.path AND h.source_mtime = s.mtime AND h.status = 'done') THEN 'history_done'
            WHEN pass = 1 AND file_id % 20 <> 1 AND {first} IS NULL THEN 'history_done' ELSE {first} END AS reason
          FROM (SELECT l.* REPLACE (l.mtime + CASE WHEN n = 1 AND file_id % 20 = 1 THEN 7 ELSE 0 END AS mtime), n::BIGINT AS pass
                FROM library l, (VALUES (0), (1)) p(n)) s)""")
    add("job_state_stream", ["job_state"], "SELECT * FROM job_state")
    add("queue_counters_stream", ["job_state"], """SELECT run_id, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS errors, 0::BIGINT AS cancelled,
        count(*) FILTER (WHERE status = 'running') AS active, 0::BIGINT AS pending, 0::BIGINT AS skipped FROM job_state GROUP BY run_id""")
    return sql
