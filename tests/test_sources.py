"""Files in and out: the streaming collection reader, the sink that commits all or nothing, and the folder source."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from waxcrate import scratch
from waxcrate.operators import files, playlists
from waxcrate.sources import collection_files, media_folder
from waxcrate.sources import collection_xml as xml


def document(rng, n):
    tracks = "".join(f'<TRACK TrackID="{rng.randint(1, 10**9)}" Name="n{i} é" Comments="{"c" * (i % 50)}"/>' for i in range(n))
    keys = "".join(f'<TRACK Key="{rng.randint(1, 99)}"/>' for _ in range(n // 2))
    return f'<?xml version="1.0" encoding="UTF-8"?><D><COLLECTION>{tracks}</COLLECTION><PLAYLISTS><NODE Name="R"><NODE Name="a" Type="1" KeyType="0">{keys}</NODE></NODE></PLAYLISTS></D>'


def test_tables_of_documents_are_read_a_few_rows_at_a_time(spark):
    """Readers and Python workers hold a batch of documents: a row group's, and so many bytes."""
    df = scratch.kept(spark.range(0, 500, 1, 1).select(F.col("id").cast("string").alias("collection_id"), F.repeat(F.lit("<x/>"), 25_000).alias("xml")), "docs", scratch.DOCUMENT_ROWS)
    (name,) = (x.removeprefix("file:").replace("//", "/") for x in df.inputFiles())
    held = pq.ParquetFile(name).metadata
    assert held.num_rows == 500 and max(held.row_group(i).num_rows for i in range(held.num_row_groups)) <= scratch.DOCUMENT_ROWS
    xml.parse_collections(df)
    sizes = df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [x.nbytes]}) for x in batches), "n long").agg(F.max("n"), F.sum("n")).first()
    assert sizes[0] < 1.2 * xml.TEXT_BATCH and sizes[1] > 4.9e7


def test_files_are_read_in_pieces(spark, tmp_path):
    """Documents over many pieces, one in another encoding, a broken one and other files: the same elements as from whole texts."""
    collection_files.register(spark)
    rng = random.Random(1)
    texts = {f"lib {i}.xml": document(rng, n) for i, n in enumerate((0, 3, 9000))}
    (tmp_path / "sub").mkdir()
    for name, text in texts.items():
        (tmp_path / "sub" / name).write_text(text)
    latin = texts["lib 1.xml"].replace("UTF-8", "ISO-8859-1")
    (tmp_path / "latin.xml").write_bytes(latin.encode("latin-1"))
    (tmp_path / "broken.xml").write_text(texts["lib 2.xml"][:-9])
    (tmp_path / "notes.txt").write_text("no document")
    read = spark.read.format("collection_xml").option("partitionBytes", 1000).load(str(tmp_path)).withColumn("collection_id", F.regexp_extract("collection_id", "[^/]*$", 0)).cache()
    whole = xml.parse_collections(spark.createDataFrame([*texts.items(), ("latin.xml", texts["lib 1.xml"])], "collection_id string, xml string"))
    shown = lambda df: sorted(str(r) for r in df.where("kind <> 'reject'").collect())
    assert shown(read) == shown(whole)
    assert [(r["collection_id"], r["reason"][:27]) for r in xml.rejects(read).collect()] == [("broken.xml", "malformed: unclosed token a")]
    assert spark.read.format("collection_xml").load(str(tmp_path / "latin.xml")).where("kind = 'track'").count() == 3


def test_sink_commits_all_files_or_none(spark, tmp_path):
    collection_files.register(spark)
    rng, out = random.Random(2), tmp_path / "out"
    texts = [(f"lib {i}.xml", document(rng, i * 7)) for i in range(23)]
    rows = spark.createDataFrame(texts, "file string, xml string").repartition(5)
    save = lambda df, mode="append": df.write.format("collection_files").mode(mode).save(str(out))
    save(rows)
    assert {x.name: x.read_text() for x in out.iterdir()} == dict(texts)  # and no staging folder is left

    more = spark.createDataFrame([(f"more {i}.xml", "<D/>") for i in range(40)], "file string, xml string").repartition(4)
    fails = more.withColumn("xml", F.when(F.col("file") == "more 17.xml", F.raise_error(F.lit("no disk")).cast("string")).otherwise(F.col("xml")))
    bad_names = [more.limit(1).withColumn("file", F.lit(x)) for x in ("a/b.xml", "", "_x", "../up")]
    for df in (fails, more.withColumn("xml", F.when(F.col("file") != "more 3.xml", F.col("xml"))), more.withColumn("file", F.lit("one.xml")), more.unionByName(rows.limit(1)), *bad_names):
        with pytest.raises(Exception):  # noqa: B017
            save(df)
        assert sorted(os.listdir(out)) == sorted(name for name, _ in texts)  # the files that were there, and nothing else
    save(rows.limit(1).withColumn("xml", F.lit("<D>new</D>")), "overwrite")
    assert sum(x.read_text() == "<D>new</D>" for x in out.iterdir()) == 1 and len(os.listdir(out)) == 23


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    """Two attempts of one task and one that is killed while it writes: only the committed one's files arrive."""
    import pyarrow as pa

    writer = collection_files.CollectionWriter({"path": str(tmp_path)}, False).prepared()
    batch = lambda n: pa.RecordBatch.from_pydict({"file": [f"{i}.xml" for i in range(n)], "xml": ["<D/>"] * n})

    def killed():
        yield batch(2)
        raise KeyboardInterrupt

    first, second = writer.write(iter([batch(3)])), writer.write(iter([batch(3)]))
    with pytest.raises(KeyboardInterrupt):
        writer.write(killed())
    assert first.files != second.files
    writer.commit([second, None])
    assert sorted(os.listdir(tmp_path)) == ["0.xml", "1.xml", "2.xml"]
    with pytest.raises(OSError):
        writer.write(iter([batch(3)]))  # too late
    other = collection_files.CollectionWriter({"path": str(tmp_path / "new")}, False).prepared()
    other.abort([other.write(iter([batch(3)])), None])
    assert os.listdir(tmp_path / "new") == []


def test_folder_source(spark, tmp_path):
    """A folder made of a manifest, against the scan of that manifest: pruned folders, hidden files, links, odd names."""
    media_folder.register(spark)
    rng, root, made = random.Random(3), tmp_path / "music", []
    folders = ["", "a", "a/b", "a/b/c", "kept", "kept/inner", "é ü", "x/y/z/deep", *(f"f{i}/g" for i in range(20))]
    for folder in folders:
        (root / folder).mkdir(parents=True, exist_ok=True)
        for i in range(rng.randint(1, 6)):
            name = rng.choice(["._hid", "song", "so.ng", ".wav"]) + str(i) + rng.choice([".mp3", ".FLAC", ".txt", "", ".m4a"])
            (root / folder / name).write_bytes(b"x" * i)
            made.append((f"{root / folder}/{name}".replace("//", "/"), i))
    for folder in ("kept", "f3/g", ""):
        (root / folder / ".marker").write_bytes(b"")
        made.append((f"{root / folder}/.marker".replace("//", "/"), 0))
    (root / "link").symlink_to(root / "a")
    manifest = spark.createDataFrame([("c", p, s) for p, s in made], "collection_id string, path string, size long")
    expected = files.scan_audio(files.prune_backups(manifest, str(root), (".marker",))).select("path", "size")
    for least in (1, 4, 1000):
        read = spark.read.format("media_folder").option("markers", ".marker").option("folders", least).load(str(root))
        assert sorted(map(tuple, files.scan_audio(read).select("path", "size").collect())) == sorted(map(tuple, expected.collect())) != []
    assert sorted(map(tuple, spark.read.format("media_folder").load(str(root)).select("path", "size").collect())) == sorted(made)
    inside = spark.read.format("media_folder").option("markers", ".marker").load(str(root / "kept"))
    assert inside.where("path LIKE '%/kept/inner/%'").count() > 0  # a marked root is still scanned
    mp3 = spark.read.format("media_folder").load(str(root)).where("extension IN ('mp3', 'm4a')")
    assert sorted(r["path"] for r in mp3.collect()) == sorted(p for p, _ in made if p.rpartition("/")[2].lower().endswith((".mp3", ".m4a")))
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("media_folder").load(str(tmp_path / "nowhere")).count()


def test_pushed_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = media_folder.FolderReader({"path": "/x"})
    other = GreaterThan(("size",), 3)
    assert list(reader.pushFilters([In(("extension",), ("mp3", "wav")), other, EqualTo(("extension",), "mp3")])) == [other] and reader.extensions == {"mp3"}


def test_from_folder_to_files(spark, tmp_path):
    """A library's file is read, its lists are sorted and written as a new file, which holds both."""
    collection_files.register(spark)
    rng = random.Random(4)
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.xml").write_text(document(rng, 40))
    docs = xml.read_collections(spark, str(tmp_path / "in"))
    elements = xml.parse_collections(docs)
    chosen, _ = playlists.choose(xml.playlists(elements), docs)
    ordered = playlists.harmonic_sort(xml.entries(elements), playlists.last_wins(xml.tracks(elements)), chosen)
    new = xml.export_sorted(docs, ordered, chosen, playlists.SORTED_FOLDER).withColumn("file", F.regexp_extract("collection_id", "[^/]*$", 0)).cache()
    new.select("file", "xml").write.format("collection_files").mode("append").save(str(tmp_path / "out"))
    assert {r["file"]: r["xml"] for r in new.collect()} == {x.name: x.read_text() for x in (tmp_path / "out").iterdir()}
    back = spark.read.format("collection_xml").load(str(tmp_path / "out")).cache()
    assert xml.playlists(back).count() == 6 and xml.rejects(back).count() == 0 and xml.entries(back).count() == 120


def test_kept_tables_can_be_cleared(spark):
    table = scratch.kept(spark.range(5), "five")
    (path,) = [x for x in table.inputFiles()[:1]]
    assert table.count() == 5 and os.path.exists(path.removeprefix("file://").removeprefix("file:"))
    assert scratch.clear(spark) >= 1 and scratch.clear(spark) == 0
    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))
