"""The library's operators as queries over the driver's tables, each with the SQL that it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import camelot, tempo
from ..functions.paths import decode_location, encode_location
from ..operators import convert, files, loudness, playlists, report
from ..operators.loudness import TpTarget
from ..sources import collection_files
from ..sources import collection_xml as xml
from ..scratch import DOCUMENT_ROWS, kept, new_path
from .fixtures import MARKERS, spread, view, with_views
from .registry import ORACLE, QUERIES


def query(name: str, sql: str | None, *views: str, once: tuple[str, ...] = ()):
    """Registers f(spark, sf_dir); it gets the views as DataFrames after them. once: views that are computed once and kept, as several read them."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spread(spark, sf_dir, *views)
            held: dict[str, DataFrame] = {}
            for v in once:
                held[v] = kept(view(spark, sf_dir, v, held), v)
            return f(*[view(spark, sf_dir, v, held) for v in views])

        QUERIES[name] = run
        if sql:
            ORACLE[name] = with_views(sql, *views)
        return f

    return register


KEYS = r"""k AS (SELECT track_id, CASE WHEN regexp_matches(trim(tonality), '^(\+?[1-9]|0[1-9]|1[0-2])[ABab]$') THEN (CAST(left(trim(tonality), length(trim(tonality))-1) AS INT)-1)*2 + CASE WHEN upper(right(trim(tonality),1))='B' THEN 1 ELSE 0 END END AS camelot,
 CASE WHEN TRY_CAST(average_bpm AS DOUBLE) > 0 THEN TRY_CAST(average_bpm AS DOUBLE) END AS bpm FROM tracks)"""


@query("harmonic_sort", f"WITH {KEYS} SELECT e.playlist_ord, CAST(row_number() OVER (PARTITION BY e.playlist_ord ORDER BY camelot ASC NULLS LAST, bpm ASC NULLS LAST, e.pos) AS INT) AS new_pos, e.track_id, camelot, bpm FROM entries e JOIN playlists p USING (playlist_ord) LEFT JOIN k ON e.track_id = k.track_id WHERE p.key_type = '0'", "entries", "tracks", "playlists")
def _harmonic_sort(entries, tracks, lists):
    return playlists.harmonic_sort(entries, tracks, lists).select("playlist_ord", "new_pos", "track_id", "camelot", "bpm")


@query("harmonic_sort_of_huge_list", f"WITH {KEYS} SELECT e.playlist_ord, row_number() OVER (PARTITION BY e.playlist_ord ORDER BY camelot ASC NULLS LAST, bpm ASC NULLS LAST, e.pos) AS new_pos, e.track_id FROM half_entries e LEFT JOIN k ON e.track_id = k.track_id WHERE e.playlist_ord IN (SELECT playlist_ord FROM half_lists)", "half_entries", "tracks", "half_lists")
def _harmonic_sort_of_huge_list(entries, tracks, lists):
    """Half of all entries are one list: it is placed by ranges, the others by windows."""
    return playlists.harmonic_sort(entries, tracks, lists.distinct(), most=1000).select("playlist_ord", "new_pos", "track_id")


@query("camelot_keys", f"WITH {KEYS} SELECT * FROM k", "tracks")
def _camelot_keys(tracks):
    return tracks.select("track_id", camelot(F.col("tonality")).alias("camelot"), tempo(F.col("average_bpm")).alias("bpm"))


def _plan_sql(target: str, rest: str = "SELECT media_id, target_tp, headroom, gain_method, effective_gain, lossless_gain_steps FROM g") -> str:
    return f"""WITH c AS (SELECT *, lower(ext) e, {target} AS target_tp FROM loudness), h AS (SELECT *, target_tp - input_tp AS headroom FROM c),
m AS (SELECT *, CASE WHEN headroom < CAST(0.05 AS DOUBLE) THEN 'None' WHEN e IN ('flac','aiff','aif','wav') THEN 'FfmpegLossless' WHEN floor(headroom/CAST(1.5 AS DOUBLE)) >= 1 THEN CASE WHEN e='mp3' THEN 'Mp3Lossless' ELSE 'AacLossless' END WHEN e='mp3' THEN 'Mp3Reencode' ELSE 'AacReencode' END AS gain_method FROM h),
g AS (SELECT *, CASE WHEN gain_method='None' THEN CAST(0 AS DOUBLE) WHEN gain_method IN ('Mp3Lossless','AacLossless') THEN floor(headroom/CAST(1.5 AS DOUBLE))*CAST(1.5 AS DOUBLE) ELSE headroom END AS effective_gain, CASE WHEN gain_method IN ('Mp3Lossless','AacLossless') THEN CAST(floor(headroom/CAST(1.5 AS DOUBLE)) AS INT) ELSE 0 END AS lossless_gain_steps FROM m) {rest}"""


UNIFORM = "CAST(-0.5 AS DOUBLE)"
SPLIT = "CASE WHEN lower(ext) IN ('flac','aiff','aif','wav') OR kbps >= 256 THEN CAST(-0.5 AS DOUBLE) ELSE CAST(-1.0 AS DOUBLE) END"
PLAN = ("media_id", "target_tp", "headroom", "gain_method", "effective_gain", "lossless_gain_steps")


@query("gain_plan_uniform", _plan_sql(UNIFORM), "loudness")
def _gain_plan_uniform(measured):
    return loudness.gain_plan(measured, TpTarget.chosen()).select(*PLAN)


@query("gain_plan_split", _plan_sql(SPLIT), "loudness")
def _gain_plan_split(measured):
    return loudness.gain_plan(measured, TpTarget.chosen(split=True)).select(*PLAN)


@query("select_files", _plan_sql(UNIFORM, "SELECT media_id, gain_method FROM g WHERE gain_method IN ('FfmpegLossless','Mp3Lossless','AacLossless')"), "loudness")
def _select_files(measured):
    return loudness.select_files(loudness.gain_plan(measured)).select("media_id", "gain_method")


_SUMMARY = """SELECT count(*) FILTER (gain_method='FfmpegLossless') AS "FfmpegLossless", count(*) FILTER (gain_method='Mp3Lossless') AS "Mp3Lossless", count(*) FILTER (gain_method='AacLossless') AS "AacLossless", count(*) FILTER (gain_method='Mp3Reencode') AS "Mp3Reencode", count(*) FILTER (gain_method='AacReencode') AS "AacReencode",
count(*) FILTER (gain_method LIKE '%Lossless') AS total_lossless, count(*) FILTER (gain_method LIKE '%Reencode') AS total_reencode, count(*) FILTER (gain_method <> 'None') > 0 AS has_processable FROM g"""


@query("method_summary", _plan_sql(SPLIT, _SUMMARY), "loudness")
def _method_summary(measured):
    return loudness.method_summary(loudness.gain_plan(measured, TpTarget.split())).drop("collection_id")


@query("processed_summary", _plan_sql(UNIFORM, _SUMMARY + " WHERE gain_method IN ('Mp3Reencode','AacReencode')"), "loudness")
def _processed_summary(measured):
    return loudness.method_summary(loudness.select_files(loudness.gain_plan(measured), lossless=False, reencode=True)).drop("collection_id")


@query("gain_plan_by_settings", """WITH c AS (SELECT *, lower(ext) AS e, CASE media_id % 6 WHEN 1 THEN CAST(-2.0 AS DOUBLE) WHEN 2 THEN CASE WHEN lower(ext) IN ('flac','aiff','aif','wav') OR kbps >= 256 THEN CAST(-0.5 AS DOUBLE) ELSE CAST(-1.0 AS DOUBLE) END WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE CAST(-0.5 AS DOUBLE) END AS target_tp,
 CASE media_id % 6 WHEN 3 THEN 'target_and_split' WHEN 4 THEN 'repeated' ELSE 'ok' END AS settings_status FROM loudness), h AS (SELECT *, target_tp - input_tp AS headroom FROM c),
m AS (SELECT *, CASE WHEN headroom IS NULL THEN NULL WHEN headroom < CAST(0.05 AS DOUBLE) THEN 'None' WHEN e IN ('flac','aiff','aif','wav') THEN 'FfmpegLossless' WHEN floor(headroom/CAST(1.5 AS DOUBLE)) >= 1 THEN CASE WHEN e='mp3' THEN 'Mp3Lossless' ELSE 'AacLossless' END WHEN e='mp3' THEN 'Mp3Reencode' ELSE 'AacReencode' END AS gain_method FROM h)
SELECT media_id, target_tp, gain_method, settings_status, CASE WHEN gain_method IS NULL THEN NULL WHEN gain_method = 'None' THEN false WHEN gain_method LIKE '%Reencode' THEN media_id % 6 = 1 ELSE media_id % 6 <> 2 END AS selected FROM m""", "loudness")
def _gain_plan_by_settings(measured):
    """Six libraries: defaults, a target with re-encoding, a split ceiling without native gain, two that conflict, and one without settings."""
    spark = measured.sparkSession
    rows = [("0", None, None, None, None, None, None), ("1", -2.0, None, None, None, True, None), ("2", None, True, None, True, None, None), ("3", -1.0, True, None, None, None, None), ("4", -1.0, None, None, None, None, None), ("4", None, None, None, None, None, None)]
    settings = spark.createDataFrame(rows, f"collection_id string, {loudness.SETTINGS}")
    own = measured.withColumn("collection_id", (F.col("media_id") % 6).cast("string"))
    return loudness.gain_plan_by_settings(own, settings).select("media_id", "target_tp", "gain_method", "settings_status", "selected")


@query("method_summary_with_write", _plan_sql(SPLIT, _SUMMARY.replace(" FROM g", ", count(*) FILTER (gain_method IS NULL) AS failures FROM g")), "loudness")
def _method_summary_with_write(measured):
    """The counts that come with the job that writes the plan."""
    plan, seen = loudness.observed(loudness.gain_plan(measured, TpTarget.split()))
    kept(plan, "plan")
    row = seen.get
    return measured.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{c} {'boolean' if c == 'has_processable' else 'long'}" for c in row))


LOGS = r"""p AS (SELECT media_id, ext, CASE WHEN regexp_extract(log, '(?s)\[Parsed_loudnorm_0 @[^{]*(\{[^{}]*\})', 1) <> '' THEN regexp_extract(log, '(?s)\[Parsed_loudnorm_0 @[^{]*(\{[^{}]*\})', 1) ELSE regexp_extract(log, '(?s).*(\{[^{}]*"input_i"[^{}]*\})', 1) END AS body, TRY_CAST(regexp_extract(regexp_extract(log, '(?m)^ *Duration:.*$'), 'bitrate: *([0-9]+) ', 1) AS INT) AS log_kbps FROM loudness_logs),
q AS (SELECT media_id, ext, log_kbps, TRY_CAST(regexp_extract(body, '"input_i" : "([^"]*)"', 1) AS DOUBLE) AS input_i, TRY_CAST(regexp_extract(body, '"input_tp" : "([^"]*)"', 1) AS DOUBLE) AS input_tp FROM p)"""


def _whole(text: str) -> str:
    return f"CASE WHEN regexp_full_match({text}, '\\+?[0-9]+') AND TRY_CAST({text} AS HUGEINT) < 4294967296 THEN TRY_CAST({text} AS BIGINT) END"


@query("parse_loudness", f"WITH {LOGS} SELECT media_id, input_i, input_tp, log_kbps FROM q", "loudness_logs")
def _parse_loudness(logs):
    return loudness.parse_logs(logs).select("media_id", "input_i", "input_tp", "log_kbps")


@query("loudness_rejects", f"WITH {LOGS} SELECT media_id, CASE WHEN input_i IS NULL THEN 'no_measurement' ELSE 'not_finite' END AS reason FROM q WHERE input_i IS NULL OR isinf(input_i)", "loudness_logs")
def _loudness_rejects(logs):
    return loudness.rejects(loudness.parse_logs(logs)).select("media_id", "reason")


@query("bitrate_fallback", f"WITH {LOGS}, r AS (SELECT media_id, json_extract_string(json, '$.format.bit_rate') AS rate FROM event_probes) SELECT media_id, CASE WHEN lower(ext) IN ('mp3','m4a','aac','mp4') THEN coalesce(log_kbps, CAST({_whole('rate')} // 1000 AS INT)) END AS kbps FROM q LEFT JOIN r USING (media_id)", "loudness_logs", "event_probes")
def _bitrate_fallback(logs, probes):
    return loudness.with_bitrate(loudness.parse_logs(logs), convert.parse_probes(probes), ["media_id"]).select("media_id", "kbps")


NAME = "regexp_extract(path, '[^/]*$')"
EXTENSION = f"lower(regexp_extract({NAME}, '^.+\\.([^.]*)$', 1))"
AUDIO = f"NOT starts_with({NAME}, '._') AND {EXTENSION} IN ('flac','aiff','aif','wav','mp3','m4a','aac','mp4')"
FOLDER = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
HIDDEN = f"marked AS (SELECT DISTINCT {FOLDER} AS d FROM media_files WHERE {NAME} IN ('.kept-originals','.saved-copies'))"


@query("scan_audio", f"SELECT file_id, path, size, CASE WHEN {EXTENSION} = 'mp3' THEN 'mp3' WHEN {EXTENSION} IN ('m4a','aac','mp4') THEN 'aac' ELSE 'lossless' END AS media_class FROM media_files WHERE {AUDIO}", "media_files")
def _scan_audio(manifest):
    return files.scan_audio(manifest).select("file_id", "path", "size", "media_class")


@query("scan_prune_backup", f"WITH {HIDDEN} SELECT file_id, path FROM media_files f WHERE {AUDIO} AND NOT EXISTS (SELECT 1 FROM marked WHERE d <> '/Music' AND starts_with(f.path, concat(d, '/')))", "media_files")
def _scan_prune_backup(manifest):
    return files.scan_audio(files.prune_backups(manifest, "/Music", MARKERS)).select("file_id", "path")


@query("resolve_inputs", f"""WITH {HIDDEN}, found AS (
 SELECT path FROM media_files f JOIN inputs i ON starts_with(f.path, concat(i.input, '/')) WHERE NOT EXISTS (SELECT 1 FROM marked WHERE length(d) > length(i.input) AND starts_with(d, i.input) AND starts_with(f.path, concat(d, '/')))
 UNION ALL SELECT path FROM media_files JOIN inputs ON path = input
 UNION ALL SELECT path FROM media_files WHERE regexp_matches(path, '^/Music/Brand#4/sub/[^/]*\\.mp3$') OR regexp_matches(path, '^/Music/Brand#4/[a-m][^/]*\\.WAV$') OR regexp_matches(path, '^/Music/Brand#5/(.*/)?[^/]*\\.flac$'))
SELECT DISTINCT path, 'ok' AS status FROM found WHERE {AUDIO} UNION ALL SELECT '/Nowhere/*.mp3', 'unmatched'
 UNION ALL SELECT input, 'unmatched' FROM inputs WHERE input LIKE '%.m4a' AND NOT EXISTS (SELECT 1 FROM media_files WHERE path = input)
 UNION ALL SELECT input, 'unmatched' FROM (VALUES ('/Music/Brand#4/sub/*.mp3', '^/Music/Brand#4/sub/[^/]*\\.mp3$'), ('/Music/Brand#4/[a-m]*.WAV', '^/Music/Brand#4/[a-m][^/]*\\.WAV$'), ('/Music/Brand#5/**/*.flac', '^/Music/Brand#5/(.*/)?[^/]*\\.flac$')) AS g(input, p) WHERE NOT EXISTS (SELECT 1 FROM media_files WHERE regexp_matches(path, p) AND {AUDIO})""", "media_files", "inputs")
def _resolve_inputs(manifest, inputs):
    found, unmatched = files.resolve_inputs(manifest, inputs, MARKERS)
    return found.select("path", F.lit("ok").alias("status")).unionByName(unmatched.select(F.col("input").alias("path"), F.lit("unmatched").alias("status")))


BASE = f"""b AS (SELECT min(string_split({FOLDER}, '/')) AS lo, max(string_split({FOLDER}, '/')) AS hi FROM media_files), n AS (SELECT lo, list_filter(range(1, len(lo) + 1), lambda i: lo[1:i] = hi[1:i]) AS same FROM b),
c AS (SELECT CASE WHEN len(same) = 1 THEN '/' ELSE array_to_string(lo[1:len(same)], '/') END AS base FROM n)"""


@query("common_base_dir", f"WITH {BASE} SELECT base FROM c", "media_files")
def _common_base_dir(manifest):
    return files.common_base(manifest).select("base")


@query("backup_manifest", f"WITH {BASE.replace('FROM media_files', f'FROM media_files WHERE {AUDIO}')} SELECT file_id, path, concat(rtrim(base, '/'), '/backup/', substring(path, length(rtrim(base, '/')) + 2)) AS backup_path FROM media_files, c WHERE {AUDIO}", "media_files")
def _backup_manifest(manifest):
    return files.backup_manifest(files.scan_audio(manifest)).select("file_id", "path", "backup_path")


@query("backup_manifest_of_roots", f"WITH r AS (SELECT file_id, CASE WHEN file_id % 2 = 0 THEN concat('/Other', path) ELSE path END AS path FROM media_files WHERE {AUDIO}) SELECT file_id, path, concat('/backup', path) AS backup_path FROM r", "media_files")
def _backup_manifest_of_roots(manifest):
    """Files with nothing in common but the root."""
    apart = manifest.withColumn("path", F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("/Other"), "path")).otherwise(F.col("path")))
    return files.backup_manifest(files.scan_audio(apart)).select("file_id", "path", "backup_path")


_LABEL = "CASE WHEN gain_method LIKE 'Mp3%' THEN 'MP3' WHEN gain_method LIKE 'Aac%' THEN 'AAC' ELSE 'Lossless' END"
_METHOD = "CASE WHEN gain_method = 'FfmpegLossless' THEN 'ffmpeg' WHEN gain_method LIKE '%Lossless' THEN 'native' ELSE 're-encode' END"


def _named(measured: DataFrame) -> DataFrame:
    return measured.withColumn("filename", F.concat(F.lit("Track "), F.col("media_id").cast("string"), F.lit("."), "ext"))


@query("gain_report", _plan_sql(UNIFORM, f"""SELECT concat('Track ', CAST(media_id AS VARCHAR), '.', ext) AS "Filename", {_LABEL} AS "Format", coalesce(CAST(kbps AS VARCHAR), '-') AS "Bitrate (kbps)", printf('%.1f', input_i) AS "LUFS", printf('%.1f', input_tp) AS "True Peak (dBTP)", printf('%.1f', target_tp) AS "Target (dBTP)", printf('%+.1f', headroom) AS "Headroom (dB)", {_METHOD} AS "Method", printf('%+.1f', effective_gain) AS "Effective Gain (dB)" FROM g WHERE gain_method <> 'None'"""), "loudness")
def _gain_report(measured):
    return report.gain_report(loudness.gain_plan(_named(measured)))


@query("sectioned_report", _plan_sql(UNIFORM, "SELECT media_id, gain_method, CAST(list_position(['FfmpegLossless','Mp3Lossless','AacLossless','Mp3Reencode','AacReencode'], gain_method) AS INT) AS section_ord, count(*) OVER (PARTITION BY gain_method) AS section_count FROM g WHERE gain_method <> 'None'"), "loudness")
def _sectioned_report(measured):
    return report.sectioned_report(loudness.gain_plan(measured)).select("media_id", "gain_method", "section_ord", "section_count")


@query("gain_work_order", _plan_sql(SPLIT, """SELECT media_id, CASE WHEN gain_method = 'FfmpegLossless' THEN 'ffmpeg' WHEN gain_method LIKE '%Lossless' THEN 'native' ELSE 'reencode' END AS tool, CASE WHEN gain_method NOT IN ('Mp3Lossless','AacLossless') THEN effective_gain END AS gain_db, CASE WHEN gain_method IN ('Mp3Lossless','AacLossless') THEN lossless_gain_steps END AS gain_steps,
CASE WHEN gain_method = 'FfmpegLossless' THEN CASE e WHEN 'flac' THEN 'flac' WHEN 'wav' THEN 'pcm_s24le' ELSE 'pcm_s24be' END END AS codec, CASE gain_method WHEN 'Mp3Reencode' THEN coalesce(kbps, 320) WHEN 'AacReencode' THEN coalesce(kbps, 256) END AS encode_kbps, CASE gain_method WHEN 'Mp3Reencode' THEN 'libmp3lame' WHEN 'AacReencode' THEN 'libfdk_aac,aac' END AS encoders FROM g WHERE gain_method <> 'None'"""), "loudness")
def _gain_work_order(measured):
    return loudness.work_order(loudness.gain_plan(measured, TpTarget.split())).select("media_id", "tool", "gain_db", "gain_steps", "codec", "encode_kbps", "encoders")


@query("tracks_dedup", "SELECT track_id, doc_pos, name, tonality, average_bpm FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY doc_pos DESC) AS n FROM repeated_tracks) WHERE n = 1", "repeated_tracks")
def _tracks_dedup(tracks):
    return playlists.last_wins(tracks).select("track_id", "doc_pos", "name", "tonality", "average_bpm")


@query("playlists_selected", "SELECT playlist_ord, path FROM playlists WHERE key_type = '0'", "playlists")
def _playlists_selected(lists):
    return playlists.selected(lists).select("playlist_ord", "path")


def _with_parts(lists: DataFrame) -> DataFrame:
    return lists.withColumn("path", F.split("path", "/"))


PARTS = "array_to_string(list_filter(list_transform(string_split(target, '/'), lambda x: trim(x)), lambda x: x <> ''), '/')"


@query("playlist_target", f"""WITH t AS (SELECT target, {PARTS} AS path FROM targets)
SELECT target, playlist_ord, CASE WHEN path = '' THEN 'empty_target' WHEN playlist_ord IS NULL THEN 'not_found' WHEN key_type <> '0' THEN 'wrong_key_type' ELSE 'ok' END AS status FROM t LEFT JOIN playlists USING (path)""", "playlists", "targets")
def _playlist_target(lists, targets):
    return playlists.find_target(_with_parts(lists), targets).select("target", "playlist_ord", "status")


@query("playlist_last_target", f"""WITH t AS (SELECT target, {PARTS} AS path FROM targets), l AS (SELECT * FROM playlists UNION ALL SELECT playlist_ord + 1000000000, path, CASE WHEN playlist_ord % 3 = 0 THEN '1' ELSE '0' END FROM playlists), m AS (SELECT path, max(playlist_ord) AS playlist_ord, max(key_type) AS k FROM l GROUP BY 1)
SELECT target, playlist_ord, CASE WHEN path = '' THEN 'empty_target' WHEN playlist_ord IS NULL THEN 'not_found' WHEN k <> '0' THEN 'wrong_key_type' ELSE 'ok' END AS status FROM t LEFT JOIN m USING (path)""", "playlists", "targets")
def _playlist_last_target(lists, targets):
    """Every path occurs twice: the last one counts, and none may be keyed by location."""
    again = lists.withColumns({"playlist_ord": F.col("playlist_ord") + 1_000_000_000, "key_type": F.when(F.col("playlist_ord") % 3 == 0, "1").otherwise("0")})
    return playlists.find_target(_with_parts(lists.unionByName(again)), targets, "last").select("target", "playlist_ord", "status")


@query("sorted_target", f"""WITH {KEYS}, s AS (SELECT collection_id, playlist_ord FROM crate_lists WHERE path = '1-URGENT/O/Set 7' AND key_type = '0')
SELECT s.collection_id, 'Tonight' AS name, CAST(row_number() OVER (PARTITION BY s.collection_id ORDER BY camelot ASC NULLS LAST, bpm ASC NULLS LAST, e.pos) AS INT) AS new_pos, e.track_id FROM s JOIN crate_entries e USING (playlist_ord) LEFT JOIN k ON e.track_id = k.track_id""", "crate_lists", "crate_entries", "crate_tracks", "tracks")
def _sorted_target(lists, entries, tracks, _every):
    """The same playlist of every collection that has it, sorted under a name of its own."""
    chosen, _ = playlists.choose(_with_parts(lists), lists, "1-URGENT / O/Set 7", "Tonight")
    return playlists.harmonic_sort(entries, tracks, chosen).join(chosen, ["collection_id", "playlist_ord"]).select("collection_id", "name", "new_pos", "track_id")


@query("sort_status", """WITH c AS (SELECT DISTINCT collection_id FROM crate_lists), l AS (SELECT * FROM crate_lists WHERE path = '1-URGENT/O/Set 7'), a AS (SELECT DISTINCT collection_id FROM crate_lists WHERE key_type = '0' AND path LIKE '5-LOW/F/%')
SELECT collection_id, 'target' AS mode, CASE WHEN l.path IS NULL THEN 'not_found' WHEN key_type <> '0' THEN 'wrong_key_type' ELSE 'ok' END AS status FROM c LEFT JOIN l USING (collection_id)
UNION ALL SELECT collection_id, 'all' AS mode, CASE WHEN a.collection_id IS NULL THEN 'no_playlists' ELSE 'ok' END AS status FROM c LEFT JOIN a USING (collection_id)""", "crate_lists")
def _sort_status(lists):
    """Each collection's status: for one target, and for all playlists of one folder."""
    _, one = playlists.choose(_with_parts(lists), lists, "1-URGENT/O/Set 7")
    _, every = playlists.choose(_with_parts(lists.where("path LIKE '5-LOW/F/%'")), lists)
    return one.select("collection_id", F.lit("target").alias("mode"), "status").unionByName(every.select("collection_id", F.lit("all").alias("mode"), "status"))


@query("playlist_counts", "SELECT playlist_ord, count(e.pos) AS n FROM playlists LEFT JOIN entries e USING (playlist_ord) GROUP BY playlist_ord", "entries", "playlists")
def _playlist_counts(entries, lists):
    return playlists.playlist_counts(entries, lists).select("playlist_ord", "n")


@query("sorted_nodes", """WITH s AS (SELECT node_ord AS playlist_ord, name FROM nodes WHERE type = '1' AND key_type = '0'), c AS (SELECT playlist_ord, name, count(e.pos) AS n FROM s LEFT JOIN (SELECT playlist_ord + 100 AS playlist_ord, pos FROM entries) e USING (playlist_ord) GROUP BY 1, 2), z AS (SELECT max(node_ord) AS z FROM nodes)
SELECT node_ord, parent_ord, name, type, key_type, CASE WHEN parent_ord IS NULL THEN '6' ELSE count END AS count, entries FROM nodes UNION ALL SELECT z + 1, 0, 'Sorted (Key+BPM)', '0', NULL, CAST((SELECT count(*) FROM c) AS VARCHAR), NULL FROM z UNION ALL SELECT z + 2 + playlist_ord, z + 1, name, '1', '0', NULL, CAST(n AS VARCHAR) FROM c, z""", "nodes", "entries")
def _sorted_nodes(nodes, entries):
    lists = nodes.where("type = '1' AND key_type = '0'").select("collection_id", F.col("node_ord").alias("playlist_ord"))
    moved = entries.withColumn("playlist_ord", F.col("playlist_ord") + 100)
    return playlists.sorted_nodes(nodes, playlists.playlist_counts(moved, lists)).drop("collection_id")


@query("decode_location", "SELECT track_id, replace(replace(replace(location, 'file://localhost', ''), '%23', '#'), '%20', ' ') AS path FROM tracks", "tracks")
def _decode_location(tracks):
    return tracks.select("track_id", decode_location(F.col("location")).alias("path"))


@query("decode_hard_locations", """SELECT track_id, CASE WHEN kind IN (2, 3, 8, 10) THEN NULL WHEN kind = 9 THEN concat('D:/', name) WHEN kind = 12 THEN concat('/', name, '/100%') ELSE concat('/', name, CASE kind WHEN 0 THEN 'ü' WHEN 1 THEN '€' WHEN 4 THEN 'a+b' WHEN 5 THEN '🎵' WHEN 6 THEN '/' WHEN 7 THEN '%' ELSE 'é ' END, '.mp3') END AS path FROM hard_locations""", "hard_locations")
def _decode_hard_locations(tracks):
    """Escapes of several bytes, broken ones, bytes that are no UTF-8, drives, a cut escape at the end and another scheme."""
    return tracks.select("track_id", decode_location(F.col("location")).alias("path"))


@query("encode_hard_locations", "SELECT track_id, concat('file://localhost', CASE WHEN starts_with(path, '/') THEN '' ELSE '/' END, replace(replace(url_encode(path), '%2F', '/'), '%3A', ':')) AS location FROM hard_paths", "hard_paths")
def _encode_hard_locations(paths):
    return paths.select("track_id", encode_location(F.col("path")).alias("location"))


@query("hard_file_names", """WITH b AS (SELECT folder, CASE folder % 7 WHEN 2 THEN regexp_extract(path, '([^/]*)\\.gz$', 1) WHEN 3 THEN '.hidden' WHEN 4 THEN ' . . ' WHEN 5 THEN regexp_extract(path, '([^/]*)\\.flac$', 1) ELSE name END AS stem FROM hard_names),
c AS (SELECT folder, rtrim(regexp_replace(stem, '[<>:"/\\\\|?*\\x00-\\x1F]', '_', 'g'), '. ') AS body FROM b)
SELECT folder, concat(CASE WHEN body = '' THEN 'track' ELSE body END, '.mp3') AS filename FROM c""", "hard_names")
def _hard_file_names(names):
    """Forbidden characters, dots and blanks at the end, paths without a name, whose track's name is taken."""
    return convert.plan_filenames(names, out_dir="folder", keep=["folder"])


@query("encode_location", "SELECT file_id, concat('file://localhost', replace(replace(path, '#', '%23'), ' ', '%20')) AS location FROM media_files", "media_files")
def _encode_location(manifest):
    return manifest.select("file_id", encode_location(F.col("path")).alias("location"))


@query("dangling_refs", "SELECT playlist_ord, pos, track_id FROM entries e WHERE NOT EXISTS (SELECT 1 FROM tracks t WHERE t.track_id = e.track_id)", "entries", "tracks")
def _dangling_refs(entries, tracks):
    return convert.dangling(entries, tracks).select("playlist_ord", "pos", "track_id")


@query("repeated_refs", "SELECT playlist_ord, track_id, count(*) AS n FROM entries GROUP BY 1, 2 HAVING count(*) > 1", "entries")
def _repeated_refs(entries):
    return convert.repeated(entries).select("playlist_ord", "track_id", "n")


@query("source_tracks", "SELECT playlist_ord, pos, track_id, name, location FROM entries JOIN tracks USING (track_id)", "entries", "tracks")
def _source_tracks(entries, tracks):
    return convert.source_tracks(entries, tracks).select("playlist_ord", "pos", "track_id", "name", "location")


@query("missing_sources", "SELECT track_id FROM tracks WHERE replace(replace(replace(location, 'file://localhost', ''), '%23', '#'), '%20', ' ') NOT IN (SELECT path FROM located_files)", "tracks", "located_files")
def _missing_sources(tracks, located):
    return convert.missing_sources(tracks, located).select("track_id")


@query("missing_total_time", "SELECT playlist_ord, pos, track_id FROM entries JOIN tracks USING (track_id) WHERE total_time IS NULL", "entries", "tracks")
def _missing_total_time(entries, tracks):
    return convert.missing_total_time(convert.source_tracks(entries, tracks)).select("playlist_ord", "pos", "track_id")


PROBED = f"""y AS (SELECT track_id, CASE WHEN json_valid(json) THEN json END AS j FROM probes), z AS (SELECT track_id, coalesce(json_extract_string(j, '$.streams[0].codec_name'), '') AS codec_name, json_extract_string(j, '$.streams[0].sample_rate') AS rate, coalesce(json_extract_string(j, '$.streams[0].bit_rate'), json_extract_string(j, '$.format.bit_rate')) AS bps FROM y WHERE json_extract(j, '$.streams[0]') IS NOT NULL),
i AS (SELECT track_id, codec_name, CAST(coalesce({_whole("rate")}, 0) AS INT) AS sample_rate, CAST(({_whole("bps")} + 500) // 1000 AS INT) AS bitrate_kbps FROM z)"""
ACTED = PROBED + """, a AS (SELECT e.playlist_ord, e.pos, e.track_id, CASE WHEN i.track_id IS NULL THEN NULL WHEN codec_name = 'mp3' AND sample_rate = 44100 AND bitrate_kbps = 320 THEN 'Copy' WHEN codec_name IN ('mp3','aac') THEN 'ReencodeLossy' ELSE 'Reencode' END AS action FROM entries e JOIN tracks t ON e.track_id = t.track_id LEFT JOIN i ON e.track_id = i.track_id)"""


@query("probe_info", f"WITH {PROBED} SELECT * FROM i", "probes")
def _probe_info(probes):
    return convert.probe_info(convert.parse_probes(probes).where("has_stream")).select("track_id", "codec_name", "sample_rate", "bitrate_kbps")


def _acted(entries: DataFrame, tracks: DataFrame, probes: DataFrame) -> DataFrame:
    return convert.actions(convert.source_tracks(entries, tracks), convert.parse_probes(probes))


@query("conversion_action", f"WITH {ACTED} SELECT * FROM a", "entries", "tracks", "probes")
def _conversion_action(entries, tracks, probes):
    return _acted(entries, tracks, probes).select("playlist_ord", "pos", "track_id", "action")


@query("action_summary", f"WITH {ACTED} SELECT action, count(*) AS n FROM a GROUP BY 1", "entries", "tracks", "probes")
def _action_summary(entries, tracks, probes):
    return convert.action_summary(_acted(entries, tracks, probes)).select("action", "n")


@query("lossy_followup", f"WITH {ACTED} SELECT a.playlist_ord, a.pos, t.name FROM a JOIN tracks t USING (track_id) WHERE action = 'ReencodeLossy'", "entries", "tracks", "probes")
def _lossy_followup(entries, tracks, probes):
    return report.lossy_followup(_acted(entries, tracks, probes)).select("playlist_ord", "pos", "name")


@query("max_track_id", "SELECT CAST(max(CASE WHEN regexp_full_match(track_id, '\\+?[0-9]+') THEN CAST(track_id AS BIGINT) ELSE 0 END) AS BIGINT) AS max_id FROM tracks", "tracks")
def _max_track_id(tracks):
    return convert.max_track_id(tracks).select(F.col("max_id").cast("long").alias("max_id"))


JUDGED = """j AS (SELECT e.*, t.doc_pos, t.name, t.comments, CASE WHEN t.track_id IS NULL THEN 'dangling' WHEN f.path IS NULL THEN 'missing_source' WHEN i.track_id IS NULL THEN 'unprobed' END AS failure FROM {entries} e LEFT JOIN tracks t ON e.track_id = t.track_id LEFT JOIN {files} f ON replace(replace(replace(t.location, 'file://localhost', ''), '%23', '#'), '%20', ' ') = f.path LEFT JOIN i ON e.track_id = i.track_id),
g AS (SELECT playlist_ord, count(*) AS entries, count(*) FILTER (failure = 'dangling') AS dangling, count(*) FILTER (failure = 'missing_source') AS missing_source, count(*) FILTER (failure = 'unprobed') AS unprobed, count(track_id) - count(DISTINCT track_id) AS repeated FROM j GROUP BY 1)"""
GATED = "CASE WHEN g.entries IS NULL THEN 'empty_playlist' WHEN dangling + missing_source + unprobed + repeated > 0 THEN 'failed' ELSE 'ok' END"


@query("conversion_gate", f"""WITH {PROBED}, {JUDGED.format(entries="entries", files="(SELECT DISTINCT path FROM located_files)")}
SELECT playlist_ord, coalesce(entries, 0) AS entries, coalesce(dangling, 0) AS dangling, coalesce(missing_source, 0) AS missing_source, coalesce(unprobed, 0) AS unprobed, coalesce(repeated, 0) AS repeated, {GATED} AS status FROM playlists LEFT JOIN g USING (playlist_ord)""", "entries", "tracks", "probes", "playlists", "located_files")
def _conversion_gate(entries, tracks, probes, lists, located):
    return convert.gate(convert.judged(entries, tracks, convert.parse_probes(probes), located), lists).drop("collection_id")


STEM = "regexp_extract(replace(replace(location, '%23', '#'), '%20', ' '), '([^/]*)\\.[^./]*$', 1)"
NAMED = f"""n AS (SELECT playlist_ord, pos, track_id, {STEM} AS stem, comments, row_number() OVER (PARTITION BY playlist_ord, lower({STEM}) ORDER BY pos) AS k FROM entries JOIN tracks USING (track_id)),
f AS (SELECT *, concat(stem, CASE WHEN k = 1 THEN '' ELSE concat(' (', CAST(k AS VARCHAR), ')') END, '.mp3') AS filename FROM n)"""


def _planned(entries: DataFrame, tracks: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Each playlist has a folder of its own, so names are planned by playlist; out_dir is that folder."""
    named = tracks.withColumn("path", decode_location(F.col("location"))).withColumn("stem", convert.safe_stem(F.col("path"), F.col("name"))).drop("path")
    sources = convert.source_tracks(entries, named).withColumn("out_dir", F.concat(F.lit("/out/"), F.col("playlist_ord").cast("string")))
    return convert.plan_filenames(sources, out_dir="playlist_ord", keep=keep, among=named, safe="stem")


@query("filename_plan", f"WITH {NAMED} SELECT playlist_ord, pos, filename FROM f", "entries", "tracks")
def _filename_plan(entries, tracks):
    return _planned(entries, tracks, ["playlist_ord", "pos"])


@query("filename_cascade", """WITH RECURSIVE s AS (SELECT folder, pos, regexp_extract(path, '([^/]*)\\.wav$', 1) AS stem FROM takes),
r(folder, pos, filename, taken) AS (SELECT folder, pos, concat(stem, '.mp3'), [lower(concat(stem, '.mp3'))] FROM s WHERE pos = 1
 UNION ALL SELECT folder, pos, filename, list_append(taken, lower(filename)) FROM (SELECT s.folder, s.pos, r.taken, list_filter(list_transform(range(1, s.pos + 1), lambda i: concat(s.stem, CASE WHEN i = 1 THEN '' ELSE concat(' (', CAST(i AS VARCHAR), ')') END, '.mp3')), lambda x: NOT list_contains(r.taken, lower(x)))[1] AS filename FROM r JOIN s ON s.folder = r.folder AND s.pos = r.pos + 1) x)
SELECT folder, pos, filename FROM r""", "takes")
def _filename_cascade(takes):
    """Stems that end in numbers meet the names made for shorter stems, over several levels."""
    return convert.plan_filenames(takes, out_dir="folder", keep=["folder", "pos"])


MADE = f"""WITH {NAMED}, x AS (SELECT max(CAST(track_id AS BIGINT)) AS x FROM tracks), w AS (SELECT playlist_ord, pos, track_id, x + row_number() OVER (PARTITION BY playlist_ord ORDER BY pos) AS new_id, concat('file://localhost/out/', CAST(playlist_ord AS VARCHAR), '/', replace(replace(replace(replace(filename, ' ', '%20'), '#', '%23'), '(', '%28'), ')', '%29')) AS location, CASE WHEN coalesce(comments, '') = '' THEN '[cdjsafe]' ELSE concat(comments, ' [cdjsafe]') END AS comments FROM f, x)"""


@query("new_tracks", MADE + " SELECT playlist_ord, pos, new_id, location, comments, 'MP3 File' AS kind, '320' AS bit_rate, '44100' AS sample_rate FROM w", "entries", "tracks")
def _new_tracks(entries, tracks):
    made = convert.new_tracks(_planned(entries, tracks), convert.max_track_id(tracks))
    return made.select("playlist_ord", "pos", F.col("new_id").cast("long").alias("new_id"), "location", "comments", "kind", "bit_rate", "sample_rate")


# Many collections: conversions from target to export, and XML documents.

CONVERTED = f"""{PROBED}, {JUDGED.format(entries="crate_entries", files="(SELECT DISTINCT collection_id AS at, path FROM crate_files)").replace("= f.path", "= f.path AND f.at = e.collection_id")}, late AS (SELECT DISTINCT playlist_ord FROM crate_entries WHERE (playlist_ord * 7 + pos) % 19 = 0),
u AS (SELECT c.collection_id, c.playlist_ord, c.path, CASE WHEN c.key_type <> '0' THEN 'wrong_key_type' WHEN {GATED} <> 'ok' THEN {GATED} WHEN late.playlist_ord IS NOT NULL THEN 'unfinished' ELSE 'ok' END AS status FROM crate_lists c LEFT JOIN g USING (playlist_ord) LEFT JOIN late USING (playlist_ord)),
o AS (SELECT collection_id, min(playlist_ord) AS playlist_ord FROM u WHERE status = 'ok' GROUP BY 1), mx AS (SELECT collection_id, max(CAST(track_id AS BIGINT)) AS mx FROM crate_tracks GROUP BY 1),
v AS (SELECT j.collection_id, j.playlist_ord, pos, j.doc_pos, j.track_id, j.name, mx + row_number() OVER (PARTITION BY j.playlist_ord ORDER BY pos) AS new_id, row_number() OVER (PARTITION BY j.playlist_ord, lower(name) ORDER BY pos) AS k, CASE WHEN coalesce(comments, '') = '' THEN '[cdjsafe]' ELSE concat(comments, ' [cdjsafe]') END AS comments, 4000000 + j.playlist_ord * 100 + pos AS size FROM j JOIN u ON j.playlist_ord = u.playlist_ord JOIN mx ON j.collection_id = mx.collection_id WHERE u.status = 'ok'),
w AS (SELECT *, concat('file://localhost/out/', collection_id, '/', CAST(playlist_ord AS VARCHAR), '/', replace(name, ' ', '%20'), CASE WHEN k = 1 THEN '' ELSE concat('%20%28', CAST(k AS VARCHAR), '%29') END, '.mp3') AS location FROM v)"""
CRATES = ("crate_targets", "crate_lists", "crate_entries", "crate_tracks", "crate_files", "probes", "crate_finished")


#: What the queries below ask of whole tracks; a caller that writes the collections again passes them all.
_ASKED = ("collection_id", "doc_pos", "track_id", "name", "location", "comments")


def _converted(targets, lists, entries, tracks, manifest, probes, finished):
    tracks = tracks.select(*_ASKED)
    probed = convert.parse_probes(probes).drop("collection_id")
    return convert.convert_playlists(targets, _with_parts(lists), entries, tracks, manifest, probed, finished, "/out", on=("track_id",))


@query("conversion_status", f"WITH {CONVERTED} SELECT collection_id, concat(' ', path, ' /') AS target, playlist_ord, status FROM u UNION ALL SELECT DISTINCT collection_id, 'None/Set 1', NULL, 'not_found' FROM crate_lists", *CRATES, once=("crate_entries",))
def _conversion_status(*views):
    return _converted(*views)[0].select("collection_id", "target", "playlist_ord", "status")


@query("converted_tracks", f"WITH {CONVERTED} SELECT collection_id, playlist_ord, pos, new_id, location, CAST(size AS VARCHAR) AS size, comments FROM w", *CRATES, once=("crate_entries",))
def _converted_tracks(*views):
    made = _converted(*views)[1]
    return made.select("collection_id", "playlist_ord", "pos", F.col("new_id").cast("long").alias("new_id"), "location", "size", "comments")


def _first_of_each(made: DataFrame) -> DataFrame:
    """An export holds one playlist: of each collection the first that is converted."""
    return made.withColumn("first", F.min("playlist_ord").over(Window.partitionBy("collection_id"))).where("playlist_ord = first").drop("first")


@query("converted_collection", f"WITH {CONVERTED}, last AS (SELECT collection_id, max(doc_pos) AS z FROM crate_tracks GROUP BY 1) SELECT collection_id, track_id, doc_pos, location, comments FROM crate_tracks UNION ALL SELECT w.collection_id, CAST(new_id AS VARCHAR), z + pos, location, comments FROM w JOIN o ON w.playlist_ord = o.playlist_ord JOIN last ON w.collection_id = last.collection_id", *CRATES, once=("crate_entries",))
def _converted_collection(targets, lists, entries, tracks, *more):
    made = _first_of_each(_converted(targets, lists, entries, tracks, *more)[1])
    return convert.converted_collection(tracks.select(*_ASKED), made).select("collection_id", "track_id", "doc_pos", "location", "comments")


def _documents(tracks: DataFrame, lists: DataFrame, entries: DataFrame) -> DataFrame:
    """XML texts of all collections: their tracks, and their playlists three folders deep (priority, status, list).

    They hold attributes, children and a top-level element that the tables don't. Only the tables' columns are shuffled; the rest is put to them after.
    """
    held = [k for k in xml.TRACK_FIELDS if k in tracks.columns]

    def track(t):
        fields = [(t[k] if k in held else F.lit(None).cast("string")).alias(f"_{x}") for k, x in xml.TRACK_FIELDS.items()]
        grid = F.array(F.struct(F.lit("0.025").alias("_Inizio"), t["average_bpm"].alias("_Bpm"), F.lit("4/4").alias("_Metro"), F.lit("1").alias("_Battito")))
        cue = F.array(F.struct(F.lit("in").alias("_Name"), F.lit("4").alias("_Type"), F.lit("1.5").alias("_Start"), F.lit("9.5").alias("_End")))
        return F.struct(*fields, F.concat(F.lit('Album "'), t["track_id"], F.lit('" & more')).alias("_Album"), F.lit("204").alias("_Rating"), grid.alias("TEMPO"), cue.alias("POSITION_MARK"), F.struct(t["track_id"].alias("_Value")).alias("OTHER"))

    own = tracks.groupBy("collection_id").agg(F.sort_array(F.collect_list(F.struct("doc_pos", *held))).alias("rows")).select("collection_id", F.transform("rows", track).alias("tracks"))
    keys = entries.groupBy("collection_id", "playlist_ord").agg(F.sort_array(F.collect_list(F.struct("pos", "track_id")))["track_id"].alias("keys"))
    parts = lists.join(keys, ["collection_id", "playlist_ord"], "left").withColumn("parts", F.split("path", "/")).withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    leaf = F.struct(F.col("parts")[2].alias("_Name"), F.lit("1").alias("_Type"), F.col("key_type").alias("_KeyType"), F.size("keys").cast("string").alias("_Entries"), F.lit("red").alias("_Colour"), F.transform("keys", lambda k: F.struct(k.alias("_Key"))).alias("TRACK"))
    folder = lambda name, items: F.struct(name.alias("_Name"), F.lit("0").alias("_Type"), F.size(items).cast("string").alias("_Count"), items.alias("NODE"))
    ordered = lambda at, node: F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), node.alias("node"))))["node"]
    second = parts.groupBy("collection_id", F.col("parts")[0].alias("a"), F.col("parts")[1].alias("b")).agg(ordered("playlist_ord", leaf).alias("items"))
    first = second.groupBy("collection_id", "a").agg(ordered("b", folder(F.col("b"), F.col("items"))).alias("items"))
    root = first.groupBy("collection_id").agg(ordered("a", folder(F.col("a"), F.col("items"))).alias("items"))
    doc = F.struct(F.lit("1.0.0").alias("_Version"), F.struct(F.lit("shop & more").alias("_Name")).alias("PRODUCT"), F.struct(F.size("tracks").cast("string").alias("_Entries"), F.col("tracks").alias("TRACK")).alias("COLLECTION"), F.struct(folder(F.lit("ROOT"), F.col("items")).alias("NODE")).alias("PLAYLISTS"))
    return own.join(root.hint("shuffle_hash"), "collection_id").select("collection_id", xml.document_text(doc).alias("xml"))


DOCUMENTS = ("crate_tracks", "crate_lists", "crate_entries")
#: What is read of documents' playlists.
TREE = {"kinds": ("node", "entry"), "attrs": ("Name", "Type", "KeyType", "Count", "Entries", "Key")}
#: What their sorting needs of tracks too.
LISTED = (*TREE["attrs"], "TrackID", "Tonality", "AverageBpm")


@query("collection_tracks", "SELECT collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY doc_pos) - 1 AS doc_pos, track_id, name, tonality, average_bpm, location, CAST(1 AS BIGINT) AS tempos, '1.5' AS cue, concat('Album \"', track_id, '\" & more') AS album FROM crate_tracks", *DOCUMENTS)
def _collection_tracks(*views):
    read = xml.tracks(xml.parse_collections(_documents(*views), kinds=("track",)))
    return read.select("collection_id", "doc_pos", "track_id", "name", "tonality", "average_bpm", "location", F.size("tempos").cast("long").alias("tempos"), F.col("position_marks")[0]["Start"].alias("cue"), F.col("attrs")["Album"].alias("album"))


@query("playlist_tree", "SELECT collection_id, path, key_type, pos - 1 AS pos, track_id FROM crate_lists JOIN crate_entries USING (collection_id, playlist_ord)", *DOCUMENTS)
def _playlist_tree(*views):
    read = kept(xml.parse_collections(_documents(*views), **TREE), "elements")
    lists = xml.playlists(read).select("collection_id", "playlist_ord", F.array_join("path", "/").alias("path"), "key_type")
    return lists.join(xml.entries(read), ["collection_id", "playlist_ord"]).select("collection_id", "path", "key_type", "pos", "track_id")


#: Folders put above the trees of some documents.
DEEP = [f"Level {n}" for n in range(30)]
_KIND = "CAST(substring(collection_id, 2, 9) AS BIGINT) % 4"


@query("collection_faults", f"""SELECT c.collection_id, CASE {_KIND} WHEN 1 THEN 'malformed' WHEN 3 THEN 'no document' ELSE 'ok' END AS status, CASE WHEN {_KIND} IN (0, 2) THEN path END AS path, CASE WHEN {_KIND} IN (0, 2) THEN n END AS n FROM
 (SELECT collection_id, concat(CASE WHEN {_KIND} = 2 THEN '{"/".join([*DEEP[1:], "ROOT"])}/' ELSE '' END, path) AS path, count(track_id) AS n FROM crate_lists LEFT JOIN crate_entries USING (collection_id, playlist_ord) WHERE {_KIND} IN (0, 2) GROUP BY collection_id, playlist_ord, path
 UNION ALL SELECT DISTINCT collection_id, NULL, NULL FROM crate_lists WHERE {_KIND} IN (1, 3)) c""", *DOCUMENTS)
def _collection_faults(*views):
    """Some documents are cut off, some are null, some have 30 folders above their tree: each is read or rejected by itself."""
    kind = F.substring("collection_id", 2, 9).cast("long") % 4
    open_tags, close_tags = "".join(f'<NODE Name="{n}" Type="0">' for n in DEEP), "</NODE>" * len(DEEP)
    deep = F.replace(F.replace("xml", F.lit("<PLAYLISTS>"), F.lit(f"<PLAYLISTS>{open_tags}")), F.lit("</PLAYLISTS>"), F.lit(f"{close_tags}</PLAYLISTS>"))
    cut = F.substring("xml", F.lit(1), (F.length("xml") / 2).cast("int"))
    docs = _documents(*views).withColumn("xml", F.when(kind == 1, cut).when(kind == 2, deep).when(kind == 0, F.col("xml")))
    read = kept(xml.parse_collections(docs, **TREE), "elements")
    counts = xml.entries(read).groupBy("collection_id", "playlist_ord").agg(F.count("*").alias("n"))
    lists = xml.playlists(read).join(counts, ["collection_id", "playlist_ord"], "left").select("collection_id", F.lit("ok").alias("status"), F.array_join("path", "/").alias("path"), F.coalesce("n", F.lit(0)).alias("n"))
    bad = xml.rejects(read).select("collection_id", F.split("reason", ":")[0].alias("status"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("n"))
    return lists.unionByName(bad)


#: What a track of the documents holds, the tables' fields and others.
_READ = "COLLECTION struct<_Entries:string,TRACK:array<struct<_TrackID:string,_Name:string,_Tonality:string,_Comments:string,_Location:string,_Kind:string,_Size:string,_BitRate:string,_SampleRate:string,_TotalTime:string,_Album:string,_Rating:string,TEMPO:array<struct<_Bpm:string>>,POSITION_MARK:array<struct<_Start:string,_End:string>>,OTHER:struct<_Value:string>>>>, PRODUCT struct<_Name:string>"


def _items(exported: DataFrame) -> DataFrame:
    """collection_id, item, value: every node and track of exported documents, read again, and their other elements."""
    text = lambda *columns: F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in columns])
    exported = kept(exported, "exported", DOCUMENT_ROWS)
    elements = kept(xml.parse_collections(exported, **TREE), "elements")
    keys = xml.entries(elements).groupBy("collection_id", F.col("playlist_ord").alias("node_ord")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "track_id")))["track_id"], ",").alias("keys"))
    nodes = xml.nodes(elements).join(keys, ["collection_id", "node_ord"], "left").select("collection_id", F.concat(F.lit("node "), F.array_join("path", "/")).alias("item"), text(F.col("type"), F.col("key_type"), F.col("count"), F.col("entries"), F.col("keys")).alias("value"))
    read = exported.select("collection_id", F.from_xml("xml", _READ, {"ignoreSurroundingSpaces": "false", "mode": "FAILFAST", "rowTag": "DJ_PLAYLISTS"}).alias("d"))
    each = read.select("collection_id", F.explode("d.COLLECTION.TRACK").alias("t"))
    own = [F.col(f"t.{c}") for c in ("_Name", "_Tonality", "_Comments", "_Location", "_Kind", "_Size", "_BitRate", "_SampleRate", "_TotalTime", "_Album", "_Rating", "OTHER._Value")]
    tracks = each.select("collection_id", F.concat(F.lit("track "), "t._TrackID").alias("item"), text(*own, F.col("t.TEMPO")[0]["_Bpm"], F.col("t.POSITION_MARK")[0]["_Start"], F.col("t.POSITION_MARK")[0]["_End"]).alias("value"))
    rest = read.select("collection_id", F.lit("document").alias("item"), text(F.col("d.PRODUCT._Name"), F.col("d.COLLECTION._Entries")).alias("value"))
    return nodes.unionByName(tracks).unionByName(rest)


def _items_sql(added: str, raised: str) -> str:
    """The items of the original documents, the root's counter raised by raised for each collection, without the documents' own rows."""
    return f"""ly AS (SELECT *, string_split(path, '/') AS p FROM crate_lists WHERE collection_id IN ({added})), ke AS (SELECT playlist_ord, CAST(count(*) AS VARCHAR) AS n, string_agg(track_id, ',' ORDER BY pos) AS keys FROM crate_entries GROUP BY 1),
items AS (SELECT collection_id, concat('node ', path) AS item, concat_ws('|', '1', key_type, '-', coalesce(n, '0'), coalesce(keys, '-')) AS value FROM ly LEFT JOIN ke USING (playlist_ord)
 UNION ALL SELECT collection_id, concat('node ', p[1], '/', p[2]), concat_ws('|', '0', '-', CAST(count(*) AS VARCHAR), '-', '-') FROM ly GROUP BY collection_id, p[1], p[2]
 UNION ALL SELECT collection_id, concat('node ', p[1]), concat_ws('|', '0', '-', CAST(count(DISTINCT p[2]) AS VARCHAR), '-', '-') FROM ly GROUP BY collection_id, p[1]
 UNION ALL SELECT collection_id, 'node ', concat_ws('|', '0', '-', CAST(count(DISTINCT p[1]) + {raised} AS VARCHAR), '-', '-') FROM ly GROUP BY collection_id
 UNION ALL SELECT collection_id, concat('track ', track_id), concat_ws('|', name, coalesce(tonality, '-'), coalesce(comments, '-'), location, '-', size, '-', '-', coalesce(total_time, '-'), concat('Album "', track_id, '" & more'), '204', track_id, coalesce(average_bpm, '-'), '1.5', '9.5') FROM crate_tracks WHERE collection_id IN ({added}))"""


@query("export_sorted_xml", f"""WITH {KEYS}, {_items_sql("SELECT collection_id FROM crate_lists WHERE key_type = '0'", "1")},
so AS (SELECT playlist_ord, CAST(count(*) AS VARCHAR) AS n, string_agg(e.track_id, ',' ORDER BY camelot ASC NULLS LAST, bpm ASC NULLS LAST, e.pos) AS keys FROM crate_entries e LEFT JOIN k ON e.track_id = k.track_id GROUP BY 1)
SELECT * FROM items UNION ALL SELECT collection_id, concat('node Sorted (Key+BPM)/', p[3]), concat_ws('|', '1', '0', '-', coalesce(n, '0'), coalesce(keys, '-')) FROM ly LEFT JOIN so USING (playlist_ord) WHERE key_type = '0'
UNION ALL SELECT collection_id, 'node Sorted (Key+BPM)', concat_ws('|', '0', '-', CAST(count(*) AS VARCHAR), '-', '-') FROM ly WHERE key_type = '0' GROUP BY 1
UNION ALL SELECT collection_id, 'document', concat('shop & more|', CAST(count(*) AS VARCHAR)) FROM crate_tracks WHERE collection_id IN (SELECT collection_id FROM ly) GROUP BY 1""", *DOCUMENTS, "tracks")
def _export_sorted_xml(tracks, lists, entries, _every):
    docs = kept(_documents(tracks, lists, entries), "documents", DOCUMENT_ROWS)
    read = kept(xml.parse_collections(docs, attrs=LISTED, children=False), "elements")
    chosen, _ = playlists.choose(xml.playlists(read), docs)
    ordered = playlists.harmonic_sort(xml.entries(read), playlists.last_wins(xml.tracks(read).select("collection_id", "doc_pos", "track_id", "tonality", "average_bpm")), chosen)
    return _items(xml.export_sorted(docs, ordered, chosen, playlists.SORTED_FOLDER))


@query("exported_files", """WITH n AS (SELECT collection_id, playlist_ord, path, key_type, count(track_id) AS n FROM crate_lists LEFT JOIN crate_entries USING (collection_id, playlist_ord) WHERE collection_id IN (SELECT collection_id FROM crate_lists WHERE key_type = '0') GROUP BY 1, 2, 3, 4)
SELECT collection_id, path, n FROM n UNION ALL SELECT collection_id, concat('Sorted (Key+BPM)/', string_split(path, '/')[3]), n FROM n WHERE key_type = '0'""", *DOCUMENTS)
def _exported_files(tracks, lists, entries):
    """Sorted exports written as files, all or none, and read back from the files piece by piece."""
    spark = tracks.sparkSession
    collection_files.register(spark)
    docs = kept(_documents(tracks, lists, entries), "documents", DOCUMENT_ROWS)
    read = kept(xml.parse_collections(docs, attrs=LISTED, children=False).where("kind <> 'reject'"), "elements")
    chosen, _ = playlists.choose(xml.playlists(read), docs)
    ordered = playlists.harmonic_sort(xml.entries(read), playlists.last_wins(xml.tracks(read).select("collection_id", "doc_pos", "track_id", "tonality", "average_bpm")), chosen)
    folder = new_path(spark, "files")
    files_ = xml.export_sorted(docs, ordered, chosen, playlists.SORTED_FOLDER).select(F.concat("collection_id", F.lit(".xml")).alias("file"), "xml")
    files_.write.format("collection_files").mode("append").save(folder)
    back = kept(spark.read.format("collection_xml").load(folder).where("kind IN ('node', 'entry')"), "elements")
    counts = xml.entries(back).groupBy("collection_id", "playlist_ord").agg(F.count("*").alias("n"))
    held = xml.playlists(back).join(counts, ["collection_id", "playlist_ord"], "left")
    return held.select(F.regexp_extract("collection_id", "([^/]*)\\.xml$", 1).alias("collection_id"), F.array_join("path", "/").alias("path"), F.coalesce("n", F.lit(0)).alias("n"))


@query("export_converted_xml", f"""WITH {CONVERTED}, {_items_sql("SELECT collection_id FROM o", "1")}, e AS (SELECT w.*, t.tonality, t.total_time, t.average_bpm FROM w JOIN o ON w.playlist_ord = o.playlist_ord JOIN tracks t ON w.track_id = t.track_id)
SELECT * FROM items UNION ALL SELECT collection_id, concat('track ', CAST(new_id AS VARCHAR)), concat_ws('|', name, coalesce(tonality, '-'), comments, location, 'MP3 File', CAST(size AS VARCHAR), '320', '44100', coalesce(total_time, '-'), concat('Album "', track_id, '" & more'), '204', track_id, coalesce(average_bpm, '-'), '1.5', '9.5') FROM e
UNION ALL SELECT collection_id, 'node CDJ-safe (MP3)', '0|-|1|-|-' FROM o UNION ALL SELECT ly.collection_id, concat('node CDJ-safe (MP3)/', p[3]), concat_ws('|', '1', '0', '-', CAST(count(*) AS VARCHAR), string_agg(CAST(new_id AS VARCHAR), ',' ORDER BY pos)) FROM ly JOIN e ON ly.playlist_ord = e.playlist_ord GROUP BY ly.collection_id, p[3]
UNION ALL SELECT c.collection_id, 'document', concat('shop & more|', CAST(count(*) + any_value(n) AS VARCHAR)) FROM crate_tracks c JOIN (SELECT collection_id, count(*) AS n FROM e GROUP BY 1) x ON c.collection_id = x.collection_id GROUP BY 1""", *CRATES, once=("crate_entries",))
def _export_converted_xml(targets, lists, entries, tracks, *more):
    """Only playlists that pass are exported, one for each collection; the library's tables are read from the documents."""
    docs = kept(_documents(tracks, lists, entries), "documents", DOCUMENT_ROWS)
    made = _first_of_each(_converted(targets, lists, entries, tracks, *more)[1])
    places = xml.tracks(xml.parse_collections(docs, kinds=("track",), attrs=("TrackID",), children=False)).select("collection_id", "track_id", F.col("doc_pos").alias("place"))
    made = made.join(places, ["collection_id", "track_id"]).drop("doc_pos").withColumnRenamed("place", "doc_pos")
    names = _with_parts(lists).select("collection_id", "playlist_ord", F.try_element_at("path", F.lit(-1)).alias("name"))
    return _items(xml.export_converted(docs, made, names, convert.FOLDER).select("collection_id", "xml"))
