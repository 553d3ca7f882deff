"""Media files: scans with pruned backup folders, mixed inputs, common base folders and backup targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename, dirname, extension, folder_parts, is_audio, media_class, relative_to
from ..scratch import kept


def scan_audio(files: DataFrame) -> DataFrame:
    """Files with a supported extension whose name doesn't begin with ._, with their class."""
    return files.where(is_audio(F.col("path"))).withColumn("media_class", media_class(extension(F.col("path"))))


def marked_folders(files: DataFrame, markers: Sequence[str], by: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    """by and folder of the folders that hold a file with one of the markers' names."""
    return files.where(basename(F.col("path")).isin(*markers)).select(*by, dirname(F.col("path")).alias("folder")).distinct()


def prune_backups(files: DataFrame, root: str, markers: Sequence[str], everything: DataFrame | None = None, by: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    """files without those below a folder that holds a marker (a file of such a name); a marked root is still scanned, and so is what holds it.

    everything: the manifest with the markers, if files has lost them. Folders are far fewer than files: they are tested once each.
    """
    marked = marked_folders(files if everything is None else everything, markers, by).withColumnRenamed("folder", "above")
    marked = marked.where((F.col("above") != root) & F.col("above").startswith(root.rstrip("/") + "/"))
    folders = files.select(*by, dirname(F.col("path")).alias("folder")).distinct()
    pruned = folders.withColumn("above", F.explode(ancestors(F.concat("folder", F.lit("/"))))).join(marked, [*by, "above"], "left_semi").select(*by, "folder").distinct()
    return files.withColumn("folder", dirname(F.col("path"))).join(pruned, [*by, "folder"], "left_anti").drop("folder")


def glob_pattern(glob: Column) -> Column:
    """A glob as a regular expression: * and ? stay within a name, **/ spans folders, [ ] is a set. A relative glob matches relative paths only."""
    p = F.regexp_replace(glob, r"([.+^$(){}|\\])", r"\\$1")
    p = F.replace(p, F.lit("**/"), F.lit("\x01"))
    p = F.replace(F.replace(p, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    p = F.replace(F.replace(p, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("[!"), F.lit("[^"))
    return F.concat(F.when(glob.startswith("/"), "^").otherwise(r"^(?!/)"), p, F.lit(r"\z"))


def fixed_folder(glob: Column) -> Column:
    """The folder that a glob names before its first wildcard."""
    return F.regexp_extract(glob, r"^([^*?\[]*)/", 1)


def folder_tree(files: DataFrame, markers: Sequence[str] = (), by: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    """One row for each folder that holds files of (by, path, folder) and each folder above it or itself (above; the top is empty), with
    deepest: the length of the longest of these that holds a marker, 0 if none does. Computed once and kept: folders are far fewer than files."""
    every = F.explode(F.array_union(F.array(F.lit("")), ancestors(F.concat("folder", F.lit("/")))))
    folders = files.select(*by, "folder").distinct()
    if markers:
        marked = marked_folders(files, markers, by).withColumnRenamed("folder", "above")
        deepest = folders.withColumn("above", every).join(marked, [*by, "above"], "left_semi").groupBy(*by, "folder").agg(F.max(F.length("above")).alias("deepest"))
        folders = folders.join(deepest, [*by, "folder"], "left")
    else:
        folders = folders.withColumn("deepest", F.lit(0))
    return kept(folders.select(*by, "folder", F.coalesce("deepest", F.lit(0)).alias("deepest"), every.alias("above")), "folders")


def resolve_inputs(files: DataFrame, inputs: DataFrame, markers: Sequence[str] = (), by: tuple[str, ...] = ("collection_id",)) -> tuple[DataFrame, DataFrame]:
    """The audio files that inputs (by, input) name, each once with parts to order by; and the inputs without a match.

    An input is a folder, a file or a glob, in this order. Only a glob without a match is an error. A folder, also one that a glob
    names, gives what a scan of it gives, without folders below it that hold a marker. Everything meets by equality: an input or a glob's
    folder before its first wildcard meets the folder tree once, what is asked of each folder meets the files once, and a file that is
    named itself is met by its path, as a folder may hold as many files as inputs name. What a folder is asked: all its files (it is
    walked), or those that match a pattern.
    """
    by_given = [*by, "given"]
    own = files.select(*by, "path", F.when(F.contains(F.col("path"), F.lit("/")), dirname(F.col("path"))).otherwise("").alias("folder"))
    tree = folder_tree(own, markers, by)
    named = inputs.select(*by, F.when(F.col("input") == "/", "").otherwise(F.rtrim("input", F.lit("/"))).alias("name"), F.col("input").alias("given")).distinct()
    name = F.col("name")
    wild = named.where(name.rlike(r"[*?\[]")).select(*by_given, fixed_folder(name).alias("above"), glob_pattern(name).alias("pattern"))
    asked = named.select(*by_given, name.alias("above")).unionByName(wild, allowMissingColumns=True)
    met = kept(tree.join(asked, [*by, "above"]), "met")
    whole = met.where("pattern IS NULL").select(*by_given, "folder", "deepest", F.col("above").alias("root"))
    under = met.where("pattern IS NOT NULL").join(whole.select(*by_given).distinct(), by_given, "left_anti")
    within = F.explode(F.array_union(F.array(F.lit("")), ancestors(F.concat("folder", F.lit("/")))))
    matched = under.select(*by_given, "folder", "deepest", "pattern", within.alias("root")).where(F.expr("root RLIKE pattern")).drop("pattern")
    walked = whole.unionByName(matched).where(F.col("deepest") <= F.length("root")).select(*by, "folder", (F.col("root") == "").alias("top")).distinct()
    single = named.select(*by_given, name.alias("path"))
    asks = walked.unionByName(under.select(*by_given, "folder", "pattern"), allowMissingColumns=True)
    path = F.col("path")
    fits = F.when(F.col("pattern").isNotNull(), F.expr("path RLIKE pattern") & is_audio(path)).otherwise((~F.col("top") | path.startswith("/")) & is_audio(path))
    from_folders = own.join(asks, [*by, "folder"]).where(fits).select(*by_given, "path", F.lit(False).alias("single"), F.col("pattern").isNotNull().alias("wild"))
    alone = own.join(single, [*by, "path"]).select(*by_given, "path", F.lit(True).alias("single"), F.lit(False).alias("wild"))
    hits = kept(from_folders.unionByName(alone), "hits")
    files_given = hits.where("single").select(*by_given).distinct()
    kept_hits = hits.where("NOT wild").select(*by, "path").unionByName(hits.where("wild").join(files_given, by_given, "left_anti").select(*by, "path"))
    found = kept_hits.where(is_audio(path)).distinct()
    answered = whole.select(*by_given).unionByName(matched.select(*by_given)).unionByName(hits.where("given IS NOT NULL").select(*by_given)).distinct()
    unmatched = named.join(answered, by_given, "left_anti").select(*by, F.col("given").alias("input"))
    return found.withColumn("parts", F.split("path", "/")), unmatched


def common_base(files: DataFrame, by: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    """The longest folder that all files' folders begin with: / for absolute ones without more in common, empty if there is none.

    The common prefix of the least and the greatest is that of all.
    """
    parts = folder_parts(F.col("path"))
    ends = files.groupBy(*by).agg(F.min(parts).alias("lo"), F.max(parts).alias("hi"))
    same = F.transform(F.arrays_zip("lo", "hi"), lambda x: x["lo"].eqNullSafe(x["hi"]))
    n = F.array_position(same, F.lit(False)).cast("int")
    prefix = F.when(n == 0, F.col("lo")).otherwise(F.slice("lo", F.lit(1), n - 1))
    return ends.select(*by, F.when(prefix == F.array(F.lit("")), "/").otherwise(F.array_join(prefix, "/")).alias("base"))


def backup_manifest(files: DataFrame, base: DataFrame | None = None, backup_dir: str | None = None, by: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    """files with the path of their backup: below backup_dir, or below backup/ in the base folder, as they lie below the base."""
    based = files.join(F.broadcast(base if base is not None else common_base(files, by)), list(by))
    inside = F.when(F.col("base") == "", "backup").otherwise(F.concat(F.rtrim("base", F.lit("/")), F.lit("/backup")))
    target = F.lit(backup_dir.rstrip("/")) if backup_dir else inside
    return based.withColumn("backup_path", F.concat(target, F.lit("/"), relative_to(F.col("path"), F.col("base"))))
