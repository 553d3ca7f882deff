"""Conversion of playlists to a uniform MP3 profile: checks, file names, actions, new tracks, and the gate before writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import whole_number
from ..functions.paths import decode_location, encode_location, sanitized, stem
from ..scratch import kept
from .playlists import find_target, last_wins

FOLDER, MARKER = "CDJ-safe (MP3)", "[cdjsafe]"
SAFE_CODEC, SAFE_RATE, SAFE_KBPS = "mp3", 44100, 320
UNIT = ("collection_id", "playlist_ord")


def dangling(entries: DataFrame, tracks: DataFrame, by: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    """Entries whose track the collection lacks."""
    return entries.join(tracks.select(*by, "track_id"), [*by, "track_id"], "left_anti")


def repeated(entries: DataFrame, unit: tuple[str, ...] = UNIT) -> DataFrame:
    """Tracks that a playlist names more than once, with how often."""
    return entries.groupBy(*unit, "track_id").agg(F.count("*").alias("n")).where("n > 1")


def source_tracks(entries: DataFrame, tracks: DataFrame, by: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    """Each entry with its track; of tracks with one id the last in the document (doc_pos) counts. Entries without a track are left out."""
    return entries.join(last_wins(tracks, (*by, "track_id")), [*by, "track_id"])


def missing_sources(sources: DataFrame, files: DataFrame, by: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    """Sources whose file the manifest lacks, or whose location can't be read (path is null)."""
    located = sources.withColumn("path", decode_location(F.col("location")))
    return located.join(files.select(*by, "path"), [*by, "path"], "left_anti")


def missing_total_time(sources: DataFrame) -> DataFrame:
    """Tracks without a total time: players drop their cues on import."""
    return sources.where(F.col("total_time").isNull())


def probe_info(probes: DataFrame) -> DataFrame:
    """probes with sample_rate (int, 0 if it is no number) and bitrate_kbps of the first stream; the stream's bit rate before the file's, also if it is no number."""
    bps = whole_number(F.coalesce("stream_bit_rate", "format_bit_rate"))
    rate = F.coalesce(whole_number(F.col("sample_rate"), (1 << 31) - 1), F.lit(0)).cast("int")
    return probes.withColumns({"sample_rate": rate, "bitrate_kbps": F.floor((bps + 500) / 1000).cast("int")})


def parse_probes(probes: DataFrame, text: str = "json") -> DataFrame:
    """probes with has_stream, codec_name, sample_rate, stream_bit_rate and format_bit_rate in place of the probe tool's JSON.

    Text that is no JSON has no stream. A stream without a codec has an empty one.
    """
    shape = "streams array<struct<codec_name string, sample_rate string, bit_rate string>>, format struct<bit_rate string>"
    own = [c for c in probes.columns if c != text]
    read = probes.select(*own, F.from_json(F.col(text), shape).alias("w_probe")).withColumn("w_first", F.get(F.col("w_probe.streams"), 0))
    some = F.col("w_first").isNotNull()
    return read.select(
        *own, some.alias("has_stream"), F.when(some, F.coalesce("w_first.codec_name", F.lit(""))).alias("codec_name"), F.col("w_first.sample_rate").alias("sample_rate"),
        F.col("w_first.bit_rate").alias("stream_bit_rate"), F.col("w_probe.format.bit_rate").alias("format_bit_rate"),
    )


def actions(sources: DataFrame, probes: DataFrame, on: tuple[str, ...] = ("collection_id", "track_id")) -> DataFrame:
    """sources with action: Copy, ReencodeLossy, Reencode, or null without a probe or where the probe (parse_probes) found no stream."""
    info = probe_info(probes.where("has_stream")).select(*on, "codec_name", F.col("sample_rate").alias("probed_rate"), "bitrate_kbps", F.lit(True).alias("probed"))
    same = (F.col("codec_name") == SAFE_CODEC) & (F.col("probed_rate") == SAFE_RATE) & (F.col("bitrate_kbps") == SAFE_KBPS)
    action = F.when(F.coalesce(same, F.lit(False)), "Copy").when(F.col("codec_name").isin("mp3", "aac"), "ReencodeLossy").otherwise("Reencode")
    return sources.join(info, list(on), "left").withColumn("action", F.when(F.col("probed"), action)).drop("probed", "probed_rate")


def action_summary(acted: DataFrame, by: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    return acted.groupBy(*by, "action").agg(F.count("*").alias("n"))


#: A stem that a number made for a shorter one may meet: that one, and the number.
_NUMBERED = r"(?s)^(.*) \(([2-9]|[1-9][0-9]{1,8})\)\z"


def safe_stem(path: Column, name: Column) -> Column:
    """The stem of a path, or the track's name where it has none, made safe."""
    return sanitized(F.coalesce(F.nullif(stem(path), F.lit("")), name))


def plan_filenames(sources: DataFrame, out_dir: str = "out_dir", pos: str = "pos", path: str = "path", name: str = "name", keep: list[str] | None = None, among: DataFrame | None = None, safe: str | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """The columns keep of sources (None: all) with filename: the source's stem made safe, .mp3, and a number where the folder has the name already.

    safe names a column that holds safe_stem already, in place of path and name: tracks that many lists share are then read once each.

    Names are taken in the order of pos (one value for each row of a folder), without regard to case. A row's number is its place among
    the rows of its stem, unless a stem like ``x (3)`` stands beside ``x``: then the first row of the one and some row of the other want
    the same name, and the earlier has it (``taken_numbers``). Only those stems are looked at, and only if there are any: with among, a smaller table
    that holds the path and name (or safe) of every source (the tracks, say), this is asked of it first. within names columns that
    out_dir follows from: rows that lie together by them already are then not shuffled for it.
    """
    keep = keep or sources.columns
    body = F.col(safe) if safe else safe_stem(F.col(path), F.col(name))
    none = among is not None and among.where(F.lower(body).rlike(_NUMBERED)).isEmpty()

    def named(folder: Column) -> DataFrame:
        return sources.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("w_kept"), F.col(pos).alias("w_pos"), folder.alias("w_dir"), body.alias("w_stem"), F.lower(body).alias("w_key"))

    if none:
        nth = F.row_number().over(Window.partitionBy(*within, out_dir, "w_key").orderBy(pos))
        numbered = sources.withColumns({"w_stem": body, "w_key": F.lower(body)}).withColumn("w_nth", nth)
        return numbered.select(*[F.col(f"`{c}`") for c in keep], _file_name(F.col("w_nth")).alias("filename"))
    # joins below need a folder that isn't null; the window alone takes the column as it is, so that it keeps a partitioning by it
    text = named(F.coalesce(F.concat(F.lit("="), F.col(out_dir).cast("string")), F.lit("")))
    taken = taken_numbers(kept(text.select("w_dir", "w_key", "w_pos"), "stems"))
    whole = Window.partitionBy("w_dir", "w_key")
    placed = (named(F.col(out_dir)) if taken is None else text).withColumn("w_nth", F.row_number().over(whole.orderBy("w_pos")))
    nth = F.col("w_nth")
    if taken is not None:
        # the i-th number taken from a stem, m, is skipped from the row on whose place is over m - i - late
        late = taken.where("NOT first").select("w_dir", "w_key", F.lit(1).alias("w_late"))
        mth = Window.partitionBy("w_dir", "w_from").orderBy("m")
        skips = taken.where("first").select("w_dir", F.col("w_from").alias("w_key"), (F.col("m") - F.row_number().over(mth) - F.col("late")).alias("w_nth"), F.lit(1).alias("w_skip"))
        both = placed.unionByName(skips, allowMissingColumns=True).withColumn("w_skip", F.coalesce("w_skip", F.lit(0)))
        skipped = F.sum("w_skip").over(whole.orderBy("w_nth", "w_skip").rowsBetween(Window.unboundedPreceding, 0))
        placed = both.withColumn("w_skipped", skipped).where("w_skip = 0").join(late, ["w_dir", "w_key"], "left")
        nth = nth + F.col("w_skipped") + F.coalesce("w_late", F.lit(0))
    return placed.select("w_kept.*", _file_name(nth).alias("filename"))


def _file_name(nth: Column) -> Column:
    return F.concat("w_stem", F.when(nth == 1, F.lit(".mp3")).otherwise(F.concat(F.lit(" ("), nth.cast("string"), F.lit(").mp3"))))


def taken_numbers(named: DataFrame) -> DataFrame | None:
    """Who has the name that a stem x and a stem ``x (m)`` both want: for each such pair w_dir, w_from (x), w_key (x (m)), m, first (whether
    the latter's first row has it) and late (1 if x's own first name is taken). None where no folder holds such a pair.

    Of a folder's stems w_key with places w_pos. x's rows take the least free number each, so x's c rows before that first row have used up
    the numbers below m just if c >= m - late - (numbers below m that others took). Who took those depends on smaller numbers and on
    shorter stems only, so doing this for all pairs at once settles after as many rounds as such names hang together; rounds end when
    nothing moves.
    """
    found = named.where(F.col("w_key").rlike(_NUMBERED))
    if found.isEmpty():
        return None
    stems = found.groupBy("w_dir", "w_key").agg(F.min("w_pos").alias("w_pos"))
    stems = stems.withColumns({"w_from": F.regexp_extract("w_key", _NUMBERED, 1), "m": F.regexp_extract("w_key", _NUMBERED, 2).cast("int")})
    asked = stems.select("w_dir", F.col("w_from").alias("w_key")).distinct()
    rows = named.join(asked, ["w_dir", "w_key"], "left_semi").select("w_dir", F.col("w_key").alias("w_from"), "w_pos", F.lit(1).alias("row"))
    before = Window.partitionBy("w_dir", "w_from").orderBy("w_pos")
    events = rows.unionByName(stems, allowMissingColumns=True).withColumns({"c": F.coalesce(F.sum("row").over(before), F.lit(0)), "some": F.max("row").over(Window.partitionBy("w_dir", "w_from"))})
    state = kept(events.where("row IS NULL AND some = 1").select("w_dir", "w_from", "w_key", "m", "c", F.lit(True).alias("first"), F.lit(0).alias("late")), "taken")
    below = Window.partitionBy("w_dir", "w_from").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        late = state.where("NOT first").select("w_dir", F.col("w_key").alias("w_from"), F.lit(1).alias("w_late"))
        moved = state.withColumn("w_others", F.coalesce(F.sum(F.col("first").cast("int")).over(below), F.lit(0))).join(late, ["w_dir", "w_from"], "left").withColumn("w_late", F.coalesce("w_late", F.lit(0)))
        moved = moved.withColumn("w_first", F.col("c") < F.col("m") - F.col("w_late") - F.col("w_others"))
        new = kept(moved.select("w_dir", "w_from", "w_key", "m", "c", F.col("w_first").alias("first"), F.col("w_late").alias("late"), ((F.col("first") != F.col("w_first")) | (F.col("late") != F.col("w_late"))).alias("w_moved")), "taken")
        state = new.drop("w_moved")
        if new.where("w_moved").isEmpty():
            return None if state.isEmpty() else state


def max_track_id(tracks: DataFrame, by: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    """The largest numeric track id; ids that are no whole number count as 0."""
    number = F.when(F.col("track_id").rlike(r"\A\+?[0-9]+\z"), F.col("track_id").try_cast("decimal(38,0)"))
    number = F.when(number < F.lit(str(1 << 64)).cast("decimal(20,0)"), number.cast("decimal(20,0)"))
    return tracks.groupBy(*by).agg(F.max(F.coalesce(number, F.lit(0).cast("decimal(20,0)"))).alias("max_id"))


def marked_comment(comments):
    return F.when(F.coalesce(comments, F.lit("")) == "", F.lit(MARKER)).otherwise(F.concat(comments, F.lit(f" {MARKER}")))


def new_tracks(planned: DataFrame, maxima: DataFrame, finished: DataFrame | None = None, by: tuple[str, ...] = ("collection_id",), unit: tuple[str, ...] = UNIT) -> DataFrame:
    """planned (out_dir, filename, pos, size, comments) as new tracks: ids after the largest, in playlist order, and the recomputed fields.

    All other columns, cues and beat grids among them, are inherited. Each playlist is its own export, so ids begin anew. finished is
    a manifest (by, path, size) of the files that were made: it gives the sizes, null for a file that is missing; without it there
    are no sizes yet.
    """
    nth = F.row_number().over(Window.partitionBy(*unit).orderBy("pos"))
    target = F.concat("out_dir", F.lit("/"), "filename")
    made = planned.withColumn("w_nth", nth).join(F.broadcast(maxima), list(by)).withColumn("w_target", target).drop("size")
    if finished is not None:
        made = made.join(finished.select(*by, F.col("path").alias("w_target"), F.col("size").cast("string").alias("size")), [*by, "w_target"], "left")
    else:
        made = made.withColumn("size", F.lit(None).cast("string"))
    return made.withColumns({
        "new_id": (F.col("max_id") + F.col("w_nth")).cast("decimal(20,0)"), "location": encode_location(F.col("w_target")), "kind": F.lit("MP3 File"),
        "bit_rate": F.lit(str(SAFE_KBPS)), "sample_rate": F.lit(str(SAFE_RATE)), "comments": marked_comment(F.col("comments")),
    }).drop("w_nth", "w_target", "max_id")


def judged(entries: DataFrame, tracks: DataFrame, probes: DataFrame, files: DataFrame | None = None, by: tuple[str, ...] = ("collection_id",), on: tuple[str, ...] = ("collection_id", "track_id")) -> DataFrame:
    """Every entry with its track (the last with that id), path, action and failure: dangling, missing_source, unprobed or null, the first that applies."""
    held = last_wins(tracks, (*by, "track_id")).withColumn("w_held", F.lit(True))
    out = actions(entries.join(held, [*by, "track_id"], "left").withColumn("path", decode_location(F.col("location"))), probes, on)
    out = out if files is None else out.join(files.select(*by, "path").distinct().withColumn("w_disk", F.lit(True)), [*by, "path"], "left")
    absent = F.lit(False) if files is None else F.col("w_disk").isNull()
    failure = F.when(F.col("w_held").isNull(), "dangling").when(absent, "missing_source").when(F.col("action").isNull(), "unprobed")
    return out.withColumn("failure", failure).drop("w_held", "w_disk")


def judged_tracks(tracks: DataFrame, probes: DataFrame, files: DataFrame, by: tuple[str, ...] = ("collection_id",), on: tuple[str, ...] = ("collection_id", "track_id")) -> DataFrame:
    """The last track of each id with path, action and failure: missing_source, unprobed or null, the first that applies."""
    out = actions(last_wins(tracks, (*by, "track_id")), probes, on).withColumn("path", decode_location(F.col("location")))
    out = out.join(files.select(*by, "path").distinct().withColumn("w_disk", F.lit(True)), [*by, "path"], "left")
    return out.withColumn("failure", F.when(F.col("w_disk").isNull(), "missing_source").when(F.col("action").isNull(), "unprobed")).drop("w_disk")


FAILURES = ("dangling", "missing_source", "unprobed")


def gate(judged_entries: DataFrame, playlists: DataFrame, unit: tuple[str, ...] = UNIT, strict: bool = False) -> DataFrame:
    """Each playlist with its failures and status: ok, empty_playlist or failed. Only ok ones are written; strict raises instead.

    A failure is an entry with one (judged), or a repeated reference (each time after the first). One aggregation by playlist.
    """
    counts = [F.count_if(F.col("failure") == f).alias(f) for f in FAILURES]
    found = judged_entries.groupBy(*unit).agg(F.count("*").alias("entries"), *counts, (F.count("track_id") - F.countDistinct("track_id")).alias("repeated"))
    names = ("entries", *FAILURES, "repeated")
    out = playlists.select(*unit).join(found, list(unit), "left").select(*unit, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])
    failures = F.col("dangling") + F.col("missing_source") + F.col("unprobed") + F.col("repeated")
    out = out.withColumn("status", F.when(F.col("entries") == 0, "empty_playlist").when(failures > 0, "failed").otherwise("ok"))
    if strict and (first := out.where("status != 'ok'").first()):
        raise ValueError(f"playlist {first.asDict()} can't be converted")
    return out


def convert_playlists(targets: DataFrame, playlists: DataFrame, entries: DataFrame, tracks: DataFrame, files: DataFrame, probes: DataFrame, finished: DataFrame, out_dir: str, by: tuple[str, ...] = ("collection_id",), on: tuple[str, ...] = ("collection_id", "track_id"), strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """A conversion from target to export: each target (by, target) with playlist_ord, name and status; and the new tracks of those that are ok.

    A target's status is that of find_target (its last match), else that of the gate, else unfinished if finished lacks one of its
    new files. Either all tracks of a playlist are converted or none; strict raises where one isn't. Files go to out_dir/<collection>/<playlist_ord>.
    Tracks are judged before their entries, so locations and paths are shuffled once a track, and entries go with a stem in place of them;
    whole tracks meet the new ones last. The targets found, the judged entries and the new tracks are computed once and kept, as both results read them.
    """
    unit = (*by, "playlist_ord")
    found = kept(find_target(playlists, targets, "last", by), "targets")
    wanted = found.where("status = 'ok'").select(*unit).distinct()
    path = decode_location(F.col("location"))
    named = F.when(F.coalesce(stem(path), F.lit("")) == "", F.col("name"))  # all that a stem may need of the name
    ready = judged_tracks(tracks.select(*by, "track_id", "doc_pos", "location", named.alias("name")), probes, files, by, on)
    body = F.when(F.col("failure").isNull(), safe_stem(F.col("path"), F.col("name")))
    ready = ready.select(*by, "track_id", "failure", body.alias("stem"), F.lit(True).alias("w_held"))
    own = entries.join(ready, [*by, "track_id"], "left").withColumn("failure", F.when(F.col("w_held").isNull(), "dangling").otherwise(F.col("failure"))).drop("w_held")
    # as gate has it, over rows that lie together by playlist
    again = F.col("track_id").isNotNull() & (F.row_number().over(Window.partitionBy(*unit, "track_id").orderBy("pos")) > 1)
    own = own.join(wanted, list(unit), "left_semi").withColumn("w_bad", F.col("failure").isNotNull() | again)
    own = kept(own.withColumn("w_failed", F.max("w_bad").over(Window.partitionBy(*unit))).drop("w_bad"), "judged")
    state = F.when(F.col("w_failed").isNull(), "empty_playlist").when(F.col("w_failed"), "failed").otherwise("ok")
    gates = wanted.join(own.groupBy(*unit).agg(F.max("w_failed").alias("w_failed")), list(unit), "left").select(*unit, state.alias("status"))
    folder = F.concat_ws("/", F.lit(out_dir), *[F.col(c).cast("string") for c in unit])
    passed = own.where("NOT w_failed").drop("w_failed").withColumn("out_dir", folder).withColumn("comments", F.lit(None).cast("string"))
    planned = plan_filenames(passed.repartition(*unit), among=passed, safe="stem", within=unit).drop("stem", "failure")
    made = kept(new_tracks(planned, max_track_id(tracks, by), finished, by, unit).drop("comments"), "made")
    late = made.where(F.col("size").isNull()).select(*unit, F.lit(True).alias("w_late")).distinct()
    status = found.join(gates.select(*unit, F.col("status").alias("w_gate")), list(unit), "left").join(late, list(unit), "left")
    state = F.when(F.col("status") != "ok", F.col("status")).when(F.col("w_gate") != "ok", F.col("w_gate")).when(F.col("w_late"), "unfinished").otherwise("ok")
    status = status.select(*by, "target", "playlist_ord", "name", state.alias("status"))
    if strict and (first := status.where("status != 'ok'").first()):
        raise ValueError(f"playlist {first.asDict()} can't be converted")
    whole = actions(last_wins(tracks, (*by, "track_id")), probes, on).withColumn("path", path)
    whole = whole.drop(*[c for c in made.columns if c not in (*by, "track_id")])
    return status, made.join(late, list(unit), "left_anti").join(whole, [*by, "track_id"]).withColumn("comments", marked_comment(F.col("comments")))


def converted_collection(tracks: DataFrame, made: DataFrame, by: tuple[str, ...] = ("collection_id",), order: str = "doc_pos") -> DataFrame:
    """The collection's tracks and the new ones after them, with continued positions."""
    ends = tracks.groupBy(*by).agg(F.max(order).alias("w_end"))
    shared = [c for c in tracks.columns if c not in (order, "track_id")]
    added = made.join(F.broadcast(ends), list(by)).select(*shared, (F.col("w_end") + F.col("pos")).cast(tracks.schema[order].dataType).alias(order), F.col("new_id").cast("string").alias("track_id"))
    return tracks.unionByName(added.select(*tracks.columns))
