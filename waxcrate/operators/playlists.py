"""Playlists: selection, harmonic order, counts, and the nodes of the sorted copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import camelot, tempo, trimmed
from ..scratch import kept
from .ranks import ranked

SORTED_FOLDER = "Sorted (Key+BPM)"


def last_wins(tracks: DataFrame, by: tuple[str, ...] = ("collection_id", "track_id"), order: str = "doc_pos") -> DataFrame:
    """One row for each track id of a collection: the last in the document, also where it lacks values."""
    rest = [c for c in tracks.columns if c not in by]
    return tracks.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*by, "row.*").select(*tracks.columns)


def track_keys(tracks: DataFrame, by: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    return tracks.select(*by, "track_id", camelot(F.col("tonality")).alias("camelot"), tempo(F.col("average_bpm")).alias("bpm"))


def selected(playlists: DataFrame) -> DataFrame:
    """Playlists that refer to tracks by id; those keyed by location can't be sorted."""
    return playlists.where(F.col("key_type") == "0")


def path_parts(text):
    """The parts of a playlist path as typed: cut at slashes, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, "/"), trimmed), lambda x: x != "")


def find_target(playlists: DataFrame, targets: DataFrame, match: str = "first", by: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    """For each target (a path as typed): target, playlist_ord, name and status ok, empty_target, not_found or wrong_key_type.

    match: "first" takes the first playlist with that path in document order; "last" the last one, and none of them may be keyed by
    location, those whose tag closes itself (closed, if playlists says so) left aside. name is the playlist's own, the last part of its path.
    """
    if match not in ("first", "last"):
        raise ValueError("match must be first or last")
    wanted = targets.select(*by, "target", path_parts(F.col("target")).alias("path")).distinct()
    opened = playlists.where(~F.col("closed")) if match == "last" and "closed" in playlists.columns else playlists
    own = opened.select(*by, "path", "playlist_ord", "key_type").withColumn("wrong", F.coalesce(F.col("key_type") != "0", F.lit(True)))
    chosen = (F.min_by if match == "first" else F.max_by)(F.struct("playlist_ord", "wrong"), F.col("playlist_ord"))
    met = wanted.where(F.size("path") > 0).join(own, [*by, "path"]).groupBy(*by, "target").agg(chosen.alias("found"), F.max("wrong").alias("any_wrong"))
    out = wanted.join(met, [*by, "target"], "left")
    wrong = F.col("found.wrong") if match == "first" else F.col("any_wrong")
    status = F.when(F.size("path") == 0, "empty_target").when(F.col("found").isNull(), "not_found").when(wrong, "wrong_key_type").otherwise("ok")
    return out.select(*by, "target", F.col("found.playlist_ord").alias("playlist_ord"), F.try_element_at("path", F.lit(-1)).alias("name"), status.alias("status"))


def choose(playlists: DataFrame, collections: DataFrame, target: str | None = None, name: str | None = None, by: tuple[str, ...] = ("collection_id",)) -> tuple[DataFrame, DataFrame]:
    """The playlists to sort with the name of each copy (by, playlist_ord, name); and each collection's status.

    Without a target all playlists that refer to tracks by id, each copy under its own name; a collection without any has the status
    no_playlists. With a target the one playlist with that path, under the given name or its own; status as of find_target. A name
    without a target, and a target without parts, are errors.
    """
    if target is None:
        if name is not None:
            raise ValueError("a name goes with a target only: of all playlists each copy keeps its own")
        chosen = selected(playlists).select(*by, "playlist_ord", F.try_element_at("path", F.lit(-1)).alias("name"))
        status = F.when(F.col("some"), "ok").otherwise("no_playlists")
        return chosen, collections.select(*by).distinct().join(chosen.select(*by, F.lit(True).alias("some")).distinct(), list(by), "left").select(*by, status.alias("status"))
    if not any(part.strip() for part in target.split("/")):
        raise ValueError("the target has no parts")
    found = find_target(playlists, collections.select(*by).distinct().withColumn("target", F.lit(target)), by=by)
    own = F.col("name") if name is None else F.lit(name)
    return found.where("status = 'ok'").select(*by, "playlist_ord", own.alias("name")), found.select(*by, "status")


def harmonic_sort(entries: DataFrame, tracks: DataFrame, playlists: DataFrame, by: tuple[str, ...] = ("collection_id",), most: int | None = None) -> DataFrame:
    """The entries of the playlists that refer to tracks by id (others are left out), with new_pos: by Camelot key, then tempo,
    unknown ones last, else as they were. playlists has key_type, or is what choose returns.

    Tracks join first; then the playlists' join and the window share the entries' exchange by playlist. A window holds a list in one task:
    with most, the lists are measured first, and those with more entries are placed in two phases over many tasks (``ranked``).
    """
    wanted = (selected(playlists) if "key_type" in playlists.columns else playlists).select(*by, "playlist_ord")
    unit = [*by, "playlist_ord"]
    keyed = entries.join(track_keys(tracks, by), [*by, "track_id"], "left").join(wanted, unit, "left_semi")
    key = [F.col("camelot").asc_nulls_last(), F.col("bpm").asc_nulls_last(), F.col("pos").asc()]
    placed = lambda df: df.withColumn("new_pos", F.row_number().over(Window.partitionBy(*unit).orderBy(*key)))
    if most is None:
        return placed(keyed)
    large = kept(entries.groupBy(*unit).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*unit), "large")
    if large.isEmpty():
        return placed(keyed)
    # lists over the size are few: their names are broadcast, as by an exchange each such list would be one task's
    keys = track_keys(tracks, by)
    own = F.broadcast(large.join(wanted, unit, "left_semi"))
    many = ranked(entries.join(own, unit, "left_semi").join(keys, [*by, "track_id"], "left"), unit, key, "new_pos").select(*keyed.columns, "new_pos")
    keyed = entries.join(F.broadcast(large), unit, "left_anti").join(keys, [*by, "track_id"], "left").join(wanted, unit, "left_semi")
    return placed(keyed).withColumn("new_pos", F.col("new_pos").cast("long")).unionByName(many)


def playlist_counts(entries: DataFrame, playlists: DataFrame, by: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    """Entries of each playlist; an empty one has 0."""
    counts = entries.groupBy(*by, "playlist_ord").agg(F.count("*").alias("n"))
    return playlists.select(*by, "playlist_ord").join(counts, [*by, "playlist_ord"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def bumped(value, add):
    """A stored counter plus add; text that is no number counts as 0."""
    number = F.regexp_extract(trimmed(value), r"^\+?[0-9]+$", 0).try_cast("long")
    return (F.coalesce(number, F.lit(0).cast("long")) + add).cast("string")


def sorted_nodes(nodes: DataFrame, counts: DataFrame, by: tuple[str, ...] = ("collection_id",), folder: str = SORTED_FOLDER) -> DataFrame:
    """The playlist tree with a folder of the sorted copies below its root, after all other nodes.

    nodes: node_ord, parent_ord (null for the root), name, type, key_type, count, entries. counts: playlist_ord (a node_ord), n.
    A copy's node_ord goes on from the last one by its source's. A collection without copies stays as it is. What has one row a
    collection is broadcast: shuffled by collection, all nodes of one would meet it in one task.
    """
    ends = nodes.groupBy(*by).agg(F.max("node_ord").alias("end"), F.min(F.when(F.col("parent_ord").isNull(), F.col("node_ord"))).alias("root"))
    totals = counts.groupBy(*by).agg(F.count("*").alias("copies")).join(ends, list(by))
    old = nodes.join(F.broadcast(totals.select(*by, "copies")), list(by), "left")
    old = old.withColumn("count", F.when(F.col("parent_ord").isNull() & F.col("copies").isNotNull(), bumped(F.col("count"), 1)).otherwise(F.col("count"))).select(*nodes.columns)
    none = F.lit(None).cast("string")
    head = totals.select(*by, (F.col("end") + 1).alias("node_ord"), F.col("root").alias("parent_ord"), F.lit(folder).alias("name"), F.lit("0").alias("type"), none.alias("key_type"), F.col("copies").cast("string").alias("count"), none.alias("entries"))
    names = nodes.select(*by, F.col("node_ord").alias("playlist_ord"), "name")
    copies = counts.join(names, [*by, "playlist_ord"]).join(F.broadcast(ends), list(by)).select(*by, (F.col("end") + 2 + F.col("playlist_ord")).alias("node_ord"), (F.col("end") + 1).alias("parent_ord"), "name", F.lit("1").alias("type"), F.lit("0").alias("key_type"), none.alias("count"), F.col("n").cast("string").alias("entries"))
    return old.unionByName(head).unionByName(copies)
