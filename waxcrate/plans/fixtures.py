"""The driver's tables seen as music libraries: plain SQL, the same text for Spark and for the oracle. @name is a driver table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked

_EXT = "CASE {0} % 7 WHEN 0 THEN 'flac' WHEN 1 THEN 'WAV' WHEN 2 THEN 'aiff' WHEN 3 THEN 'mp3' WHEN 4 THEN 'MP3' WHEN 5 THEN 'm4a' ELSE 'aac' END"

#: A collection of 200 orders.
_CRATE = "concat('c', CAST(CAST(floor({0} / 200.0) AS BIGINT) AS VARCHAR(20)))"

VIEWS = {
    "tracks": f"""SELECT CAST(p_partkey AS BIGINT) AS doc_pos, CAST(p_partkey AS VARCHAR(20)) AS track_id, p_name AS name,
 CASE WHEN p_partkey % 29 < 24 THEN concat(CAST(CAST(floor((p_partkey % 29) / 2.0) AS INT) + 1 AS VARCHAR(5)), CASE WHEN (p_partkey % 29) % 2 = 0 THEN 'A' ELSE 'B' END)
  WHEN p_partkey % 29 = 24 THEN 'Am' WHEN p_partkey % 29 = 25 THEN '' WHEN p_partkey % 29 = 26 THEN '13A' WHEN p_partkey % 29 = 28 THEN ' 1a ' END AS tonality,
 CASE WHEN p_partkey % 31 = 0 THEN '0.00' WHEN p_partkey % 31 = 2 THEN 'n/a' WHEN p_partkey % 31 > 2 THEN concat(CAST(90 + p_partkey % 90 AS VARCHAR(5)), '.50') END AS average_bpm,
 concat('file://localhost/Music/', replace(p_brand, '#', '%23'), '/', replace(p_name, ' ', '%20'), '.', {_EXT.format("p_partkey")}) AS location,
 CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(120 + p_partkey % 200 AS VARCHAR(5)) END AS total_time,
 CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('note ', p_brand) END AS comments,
 CAST(1000000 + p_size * 20000 AS VARCHAR(20)) AS size FROM @part""",
    "repeated_tracks": """SELECT * FROM tracks UNION ALL SELECT doc_pos + 1000000000 AS doc_pos, track_id, concat(name, ' (again)') AS name, CASE WHEN doc_pos % 2 = 0 THEN tonality END AS tonality, CAST(NULL AS VARCHAR(5)) AS average_bpm, location, total_time, comments, size FROM tracks WHERE doc_pos % 5 = 0""",
    "playlists": """SELECT o_orderkey AS playlist_ord, concat(o_orderpriority, '/Order ', CAST(o_orderkey AS VARCHAR(20))) AS path, CASE WHEN o_orderstatus = 'P' THEN '1' ELSE '0' END AS key_type FROM @orders""",
    "entries": """SELECT l_orderkey AS playlist_ord, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS BIGINT) AS pos, CAST(l_partkey + CASE WHEN l_partkey % 97 = 0 THEN 1000000 ELSE 0 END AS VARCHAR(20)) AS track_id FROM @lineitem""",
    "half_entries": """SELECT CASE WHEN l_orderkey % 2 = 0 THEN CAST(0 AS BIGINT) ELSE l_orderkey END AS playlist_ord, CAST(row_number() OVER (PARTITION BY CASE WHEN l_orderkey % 2 = 0 THEN CAST(0 AS BIGINT) ELSE l_orderkey END ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS BIGINT) AS pos, CAST(l_partkey + CASE WHEN l_partkey % 97 = 0 THEN 1000000 ELSE 0 END AS VARCHAR(20)) AS track_id FROM @lineitem""",
    "half_lists": """SELECT o_orderkey AS playlist_ord, '0' AS key_type FROM @orders UNION ALL SELECT CAST(0 AS BIGINT), '0' FROM @orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM @orders)""",
    "loudness": f"""SELECT event_id AS media_id, {_EXT.format("event_id")} AS ext,
 CAST(200 - (event_id * 37) % 1200 AS DOUBLE) / 100 AS input_tp, CAST(-700 - (event_id * 53) % 900 AS DOUBLE) / 100 AS input_i,
 CASE event_id % 5 WHEN 0 THEN 320 WHEN 1 THEN 256 WHEN 2 THEN 192 WHEN 3 THEN 128 END AS kbps FROM @events""",
    "media_files": """SELECT p_partkey AS file_id, concat('/Music/', p_brand, '/', CASE WHEN p_partkey % 3 = 0 THEN 'sub/' ELSE '' END, CASE WHEN p_partkey % 23 = 0 THEN '._' ELSE '' END, p_name, ' ', CAST(p_partkey AS VARCHAR(20)), CASE p_partkey % 9 WHEN 0 THEN '.flac' WHEN 1 THEN '.WAV' WHEN 2 THEN '.aiff' WHEN 3 THEN '.mp3' WHEN 4 THEN '.Mp3' WHEN 5 THEN '.m4a' WHEN 6 THEN '.aac' WHEN 7 THEN '.txt' ELSE '' END) AS path, CAST(1000000 + p_size * 20000 AS BIGINT) AS size FROM @part
 UNION ALL SELECT DISTINCT -1, concat('/Music/', p_brand, '/', CASE WHEN p_brand = 'Brand#3' THEN '.saved-copies' ELSE '.kept-originals' END), CAST(60 AS BIGINT) FROM @part WHERE p_brand IN ('Brand#2', 'Brand#3')""",
    "inputs": """SELECT DISTINCT concat('/Music/', p_brand) AS input FROM @part WHERE p_brand IN ('Brand#1', 'Brand#2')
 UNION ALL SELECT '/Music/Brand#4/sub/*.mp3' UNION ALL SELECT '/Music/Brand#4/[a-m]*.WAV' UNION ALL SELECT '/Music/Brand#5/**/*.flac' UNION ALL SELECT '/Nowhere/*.mp3' UNION ALL SELECT concat('/Music/', p_brand, '/', p_name, ' ', CAST(p_partkey AS VARCHAR(20)), '.m4a') FROM @part WHERE p_partkey % 90 = 5""",
    "located_files": """SELECT doc_pos, concat(replace(replace(replace(location, 'file://localhost', ''), '%23', '#'), '%20', ' '), '') AS path FROM tracks WHERE doc_pos % 13 <> 0""",
    "loudness_logs": f"""SELECT event_id AS media_id, {_EXT.format("event_id")} AS ext,
 concat('  tag: ', props, '{{', chr(10), '  Duration: 00:03:50.32, start: 0.025057, bitrate: ', CASE event_id % 5 WHEN 0 THEN '320 kb/s' WHEN 1 THEN '256 kb/s' WHEN 2 THEN '192 kb/s' WHEN 3 THEN '128 kb/s' ELSE 'N/A' END, chr(10),
 CASE WHEN event_id % 11 = 0 THEN 'Some other output' WHEN event_id % 13 = 0 THEN '' ELSE '[Parsed_loudnorm_0 @ 0xc8f448a80] N/A speed=30.3x' END, chr(10), CASE WHEN event_id % 101 = 0 THEN 'no data' ELSE concat('{{', chr(10), CASE WHEN event_id % 199 = 0 THEN concat(chr(9), '"pad" : "', repeat('x', 4000), '",', chr(10)) ELSE '' END, chr(9), '"input_i" : "', CASE WHEN event_id % 53 = 0 THEN '-inf' ELSE CAST(CAST(-700 - (event_id * 53) % 900 AS DOUBLE) / 100 AS VARCHAR(20)) END, '",', chr(10), chr(9), '"input_tp" : "', CASE WHEN event_id % 53 = 0 THEN '-inf' ELSE CAST(CAST(200 - (event_id * 37) % 1200 AS DOUBLE) / 100 AS VARCHAR(20)) END, '"', chr(10), '}}') END, chr(10),
 CASE WHEN event_id % 13 = 0 THEN '[Parsed_loudnorm_0 @ 0xc8f448a80] nothing follows' ELSE '[out#0/null] video:0KiB' END) AS log FROM @events""",
    "probes": """SELECT CAST(p_partkey AS VARCHAR(20)) AS track_id, CASE WHEN p_partkey % 37 = 0 THEN 'no data' WHEN p_partkey % 41 = 0 THEN '{"streams": [], "format": {"bit_rate": "320000"}}' ELSE concat('{"streams": [{"codec_name": "', CASE p_partkey % 7 WHEN 0 THEN 'flac' WHEN 1 THEN 'pcm_s16le' WHEN 2 THEN 'alac' WHEN 5 THEN 'aac' ELSE 'mp3' END,
 '", "sample_rate": "', CASE WHEN p_partkey % 4 = 0 THEN '48000' WHEN p_partkey % 31 = 0 THEN ' 44100' ELSE '44100' END, '"', CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN ', "bit_rate": "N/A"' WHEN 2 THEN ', "bit_rate": "128000"' WHEN 3 THEN ', "bit_rate": "319600"' ELSE ', "bit_rate": "320000"' END,
 '}, {"codec_name": "mjpeg"}], "format": {', CASE WHEN p_partkey % 12 = 0 THEN '' ELSE '"bit_rate": "320499"' END, '}}') END AS json FROM @part WHERE p_partkey % 43 <> 0""",
    "event_probes": """SELECT event_id AS media_id, CASE WHEN event_id % 12 = 0 THEN '{"format": {}}' WHEN event_id % 7 = 0 THEN '{"format": {"bit_rate": "N/A"}}' WHEN event_id % 17 = 0 THEN '{"format": {"bit_rate": "-128000"}}' ELSE concat('{"format": {"bit_rate": "', CAST(128000 + event_id % 192000 AS VARCHAR(20)), '"}}') END AS json FROM @events WHERE event_id % 3 <> 1""",
    "targets": """SELECT concat(' ', o_orderpriority, ' / Order ', CAST(o_orderkey AS VARCHAR(20)), ' /') AS target FROM @orders UNION ALL SELECT '1-URGENT/None' UNION ALL SELECT ' / '""",
    "nodes": """SELECT CAST(0 AS BIGINT) AS node_ord, CAST(NULL AS BIGINT) AS parent_ord, 'ROOT' AS name, '0' AS type, CAST(NULL AS VARCHAR(5)) AS key_type, ' 5 ' AS count, CAST(NULL AS VARCHAR(20)) AS entries
 UNION ALL SELECT CAST(substring(o_orderpriority, 1, 1) AS BIGINT), CAST(0 AS BIGINT), o_orderpriority, '0', CAST(NULL AS VARCHAR(5)), CAST(count(*) AS VARCHAR(20)), CAST(NULL AS VARCHAR(20)) FROM @orders GROUP BY o_orderpriority
 UNION ALL SELECT CAST(o_orderkey + 100 AS BIGINT), CAST(substring(o_orderpriority, 1, 1) AS BIGINT), concat('Order ', CAST(o_orderkey AS VARCHAR(20))), '1', CASE WHEN o_orderstatus = 'P' THEN '1' ELSE '0' END, CAST(NULL AS VARCHAR(20)), '0' FROM @orders""",
    "crate_lists": f"""SELECT {_CRATE.format("o_orderkey")} AS collection_id, o_orderkey AS playlist_ord, concat(o_orderpriority, '/', o_orderstatus, '/Set ', CAST(o_orderkey % 200 AS VARCHAR(20))) AS path, CASE WHEN o_orderstatus = 'P' THEN '1' ELSE '0' END AS key_type FROM @orders""",
    "crate_entries": f"""SELECT {_CRATE.format("playlist_ord")} AS collection_id, playlist_ord, pos, track_id FROM entries""",
    "crate_tracks": """SELECT c.collection_id, t.* FROM (SELECT DISTINCT collection_id, track_id FROM crate_entries) c JOIN tracks t ON c.track_id = t.track_id""",
    "crate_files": """SELECT c.collection_id, f.path FROM crate_tracks c JOIN located_files f ON c.doc_pos = f.doc_pos""",
    "crate_finished": """SELECT collection_id, concat('/out/', collection_id, '/', CAST(playlist_ord AS VARCHAR(20)), '/', name, CASE WHEN k = 1 THEN '' ELSE concat(' (', CAST(k AS VARCHAR(20)), ')') END, '.mp3') AS path, CAST(4000000 + playlist_ord * 100 + pos AS BIGINT) AS size
 FROM (SELECT c.collection_id, c.playlist_ord, c.pos, t.name, row_number() OVER (PARTITION BY c.playlist_ord, lower(t.name) ORDER BY c.pos) AS k FROM crate_entries c JOIN tracks t ON c.track_id = t.track_id) x WHERE (playlist_ord * 7 + pos) % 19 <> 0""",
    "hard_locations": """SELECT CAST(p_partkey AS VARCHAR(20)) AS track_id, CASE p_partkey % 13 WHEN 8 THEN concat('http://localhost/', p_name) WHEN 9 THEN concat('file://localhost/D:/', replace(p_name, ' ', '%20')) WHEN 12 THEN concat('file:///', replace(p_name, ' ', '%20'), '/100%') ELSE
 concat('file://localhost/', replace(p_name, ' ', '%20'), CASE p_partkey % 13 WHEN 0 THEN '%C3%BC' WHEN 1 THEN '%e2%82%ac' WHEN 2 THEN '%zz' WHEN 3 THEN '%FF' WHEN 4 THEN 'a+b' WHEN 5 THEN '%F0%9F%8E%B5' WHEN 6 THEN '%2F' WHEN 7 THEN '%25' WHEN 10 THEN '%C3' ELSE '%C3%A9%20' END, '.mp3') END AS location, p_name AS name, CAST(p_partkey % 13 AS INT) AS kind FROM @part""",
    "hard_paths": """SELECT CAST(p_partkey AS VARCHAR(20)) AS track_id, concat(CASE WHEN p_partkey % 3 = 0 THEN 'D:' ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '/' END, p_name, CASE p_partkey % 7 WHEN 0 THEN ' (1)*!' WHEN 1 THEN 'ü & €' WHEN 2 THEN '100%+1' WHEN 3 THEN '~a_b-c.d' WHEN 4 THEN '"[x]{y}"' WHEN 5 THEN concat('#?;=', chr(64), ',$') ELSE 'é:é' END, '/', chr(9), '.mp3') AS path FROM @part""",
    "hard_names": """SELECT p_partkey AS folder, CAST(1 AS BIGINT) AS pos, concat(p_name, CASE p_partkey % 6 WHEN 0 THEN ' a/b:c' WHEN 1 THEN '. .' WHEN 2 THEN '<*>?' WHEN 3 THEN concat(chr(9), 'x') WHEN 4 THEN concat('"|', chr(92)) ELSE '' END) AS name,
 CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('/in/', p_name, ' a:b?.tar.gz') WHEN 3 THEN '/in/.hidden' WHEN 4 THEN '/in/ . . .wav' WHEN 5 THEN concat('/in/', p_name, '...flac') ELSE '/in/' END AS path FROM @part""",
    "takes": """SELECT CAST(floor(l_orderkey / 16.0) AS BIGINT) AS folder, CAST(row_number() OVER (PARTITION BY floor(l_orderkey / 16.0) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS BIGINT) AS pos,
 concat('/in/', CASE l_partkey % 7 WHEN 0 THEN 'Take' WHEN 1 THEN 'take (2)' WHEN 2 THEN 'Take (3)' WHEN 3 THEN 'take (2) (2)' WHEN 4 THEN 'Take' WHEN 5 THEN 'TAKE (5)' ELSE concat('other (', CAST(l_partkey % 5 AS VARCHAR(5)), ')') END, '.wav') AS path, 'n' AS name FROM @lineitem""",
    "crate_targets": """SELECT collection_id, concat(' ', path, ' /') AS target FROM crate_lists UNION ALL SELECT DISTINCT collection_id, 'None/Set 1' FROM crate_lists""",
}
NEEDS = {
    "repeated_tracks": ("tracks",), "located_files": ("tracks",), "crate_entries": ("entries",), "crate_tracks": ("crate_entries", "tracks"), "crate_files": ("crate_tracks", "located_files"),
    "crate_finished": ("crate_entries", "tracks"), "crate_targets": ("crate_lists",),
}
TABLES = ("part", "orders", "lineitem", "events")


#: Files that mark a folder of backups.
MARKERS = (".kept-originals", ".saved-copies")


#: The end of the order of entries. Rows that are equal up to it have the same columns in the view, whatever their order, so Spark's text
#: of the view leaves it out, and shuffles three columns instead of seven.
_REST = ", l_suppkey, l_extendedprice, l_quantity, l_shipdate"


def view(spark: SparkSession, sf_dir: str, name: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """The fixture as a DataFrame with collection_id: that of the crate_ views, or one for all. held: views that are tables already."""
    if held and name in held:
        return held[name]
    sql = VIEWS[name].replace(_REST, "") if name == "entries" else VIEWS[name]
    if name == "half_entries":
        return _half_entries(spark, sf_dir)
    for t in TABLES:
        if f"@{t}" in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"waxcrate_{t}")
            sql = sql.replace(f"@{t}", f"waxcrate_{t}")
    for needed in NEEDS.get(name, ()):
        own = view(spark, sf_dir, needed, held)
        if name == "crate_tracks" and needed == "crate_entries":
            own = own.repartition("track_id")  # one shuffle serves the distinct rows, the join, and what goes on by track
        (own if needed.startswith("crate_") else own.drop("collection_id")).createOrReplaceTempView(f"waxcrate_{needed}")
        sql = re.sub(rf"\b(FROM|JOIN) {needed}\b", rf"\1 waxcrate_{needed}", sql)
    out = spark.sql(sql)
    return out if "collection_id" in out.columns else out.withColumn("collection_id", F.lit("main"))


def _half_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of that name: half of all rows are one list, so its places are counted over many tasks, not by its window in one."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.when(F.col("l_orderkey") % 2 == 0, F.lit(0).cast("long")).otherwise(F.col("l_orderkey")).alias("playlist_ord"), *order)
    track = F.col("l_partkey") + F.when(F.col("l_partkey") % 97 == 0, 1000000).otherwise(0)
    placed = ranked(rows, ["playlist_ord"], [F.col(c) for c in order], "pos")
    return placed.select("playlist_ord", "pos", track.cast("string").alias("track_id"), F.lit("main").alias("collection_id"))


#: Bytes of the tables' files for each partition of an exchange.
SHARE = 4 << 20
_SPREAD = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_set: dict[str, str] = {}


def spread(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """Lets exchanges begin with a partition for each SHARE of the views' tables, if the session's number is smaller; AQE joins small ones.

    A fixed number makes the largest task grow with the tables. A number that the caller has set stays. Returns the number wanted.
    """
    sql = " ".join(VIEWS[v] for name in names for v in _with_needed(name))
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet") for t in TABLES if f"@{t}" in sql]
    size = sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in paths)
    wanted, now = -(-size // SHARE), spark.conf.get(_SPREAD, None)
    if now is None or now == _set.get(_SPREAD):
        if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
            _set[_SPREAD] = str(wanted)
            spark.conf.set(_SPREAD, str(wanted))
        else:
            spark.conf.unset(_SPREAD)
    return wanted


def _with_needed(name: str) -> list[str]:
    return [*(v for needed in NEEDS.get(name, ()) for v in _with_needed(needed)), name]


def with_views(sql: str, *names: str) -> str:
    """sql for the oracle, behind the views it names."""
    every = list(dict.fromkeys(v for name in names for v in _with_needed(name)))
    head = ", ".join(f"{v} AS ({VIEWS[v].replace('@', '')})" for v in every)
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {sql[15:]}"
    return f"WITH {head}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {head} {sql}"
