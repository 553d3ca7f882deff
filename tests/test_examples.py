"""Behaviour by example: keys, order, logs, locations, names, documents."""

import random
import re
import time
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from waxcrate.functions.keys import camelot, tempo
from waxcrate.functions.numbers import one_decimal, whole_number
from waxcrate.functions.paths import decode_location, encode_location, sanitized
from waxcrate.operators import convert, files, loudness, playlists, report
from waxcrate.operators.ranks import ranked
from waxcrate.plans import fixtures
from waxcrate.sources import collection_xml as xml
from waxcrate.streaming.gain import gain_sink, planned_stream


def values(spark, rows, expression, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_camelot(spark):
    assert values(spark, ["1A", "1B", "2A", "12A", "12B", " 1a ", "+1A", "01A"], camelot) == [0, 1, 2, 22, 23, 0, 0, 0]
    assert values(spark, ["", "0A", "13A", "1C", "Am", "C#", "1Ä", "é", "100A", None], camelot) == [None] * 10


def test_tempo(spark):
    assert values(spark, ["120.50", "0", "-3", "nan", "1.5d", " 1", "", None], tempo) == [120.5] + [None] * 7


def test_locations(spark):
    """Against a reader of escapes written byte by byte, on random URLs with whole, broken and cut escapes."""

    def plainly(url):
        if not url.startswith("file://"):
            return None
        data, out, at = url.removeprefix("file://").removeprefix("localhost").encode(), b"", 0
        while at < len(data):
            if data[at : at + 1] == b"%" and at + 2 < len(data):
                if not re.fullmatch(rb"[0-9A-Fa-f]{2}", data[at + 1 : at + 3]):
                    return None
                out, at = out + bytes([int(data[at + 1 : at + 3], 16)]), at + 3
            else:
                out, at = out + data[at : at + 1], at + 1
        try:
            return re.sub(r"^/(?=[\x00-\x7F]:)", "", out.decode())
        except UnicodeDecodeError:
            return None

    rng = random.Random(11)
    parts = ["%20", "%C3%BC", "%c3%a9", "%E2%82%AC", "%F0%9F%8E%B5", "%FF", "%80", "%zz", "%", "%4", "+", "/", "Q:", "vinyl", "ü", "#", "%23", "%2F", "%25"]
    urls = ["".join([rng.choice(["file://localhost/", "file:///", "file://", "smb://h/"]), *rng.choices(parts, weights=[5, 5, 5, 5, 5, 1, 1, 1, 1, 1, *[5] * 9], k=rng.randint(0, 6))]) for _ in range(600)]
    expected = [plainly(u) for u in urls]
    assert values(spark, urls, decode_location) == expected and 60 < expected.count(None) < 400
    paths = ["/" + "".join(chr(rng.choice([*range(32, 127), 0xE9, 0x416, 0x6F22, 0x1F3B5])) for _ in range(12)).replace("\\", "") for _ in range(200)]
    assert values(spark, paths, encode_location) == ["file://localhost" + quote(p, safe="/:~-._") for p in paths]
    assert values(spark, paths, lambda x: decode_location(encode_location(x))) == [re.sub(r"^/(?=[\x00-\x7F]:)", "", p) for p in paths]


def test_sanitized(spark):
    assert values(spark, ['AC/DC: "live"?.wav', "dots. .", "", " . ", "del\x7fete\x85", "tab\there\n"], sanitized) == ["AC_DC_ _live__.wav", "dots", "track", "track", "del\x7fete\x85", "tab_here_"]


def test_whole_numbers(spark):
    assert values(spark, ["320000", "+7", " 7", "-1", "7.0", "4294967295", "4294967296", "9" * 60, "", "7\n", None], whole_number) == [320000, 7, None, None, None, 4294967295, None, None, None, None, None]


def test_one_decimal(spark):
    numbers = [0.05, 0.15, 0.25, -0.04, 2.675, -0.25, 1.35, 100.0]
    assert values(spark, numbers, lambda x: one_decimal(x, sign=True), "double") == ["%+.1f" % x for x in numbers]


def sort_case(spark, tracks):
    t = spark.createDataFrame([("c", i, k, b) for i, k, b in tracks], "collection_id string, track_id string, tonality string, average_bpm string")
    e = spark.createDataFrame([("c", 1, n, t[0]) for n, t in enumerate(tracks)], "collection_id string, playlist_ord int, pos int, track_id string")
    p = spark.createDataFrame([("c", 1, "0")], "collection_id string, playlist_ord int, key_type string")
    return "".join(r["track_id"] for r in playlists.harmonic_sort(e, t, p).orderBy("new_pos").collect())


def test_harmonic_order(spark):
    assert sort_case(spark, [("p", "5B", "101"), ("q", "5B", "99.5"), ("r", "2A", "170"), ("s", "11A", "90")]) == "rqps"
    assert sort_case(spark, [("v", "Am", "80"), ("w", "12B", "x"), ("x", None, "70"), ("y", "12B", "200"), ("z", "12B", "0")]) == "ywzxv"


LOG = '[Parsed_loudnorm_0 @ 0x1] \n{\n\t"input_i" : "-9.31",\n\t"input_tp" : "0.74"\n}\n'
PLAIN = '{"input_i" : "-11.50", "input_tp" : "-3.25"}'


def test_logs(spark):
    logs = [
        ("stray", "junk{ x\nDuration: 00:01, bitrate: 256 kb/s\n" + LOG, (-9.31, 0.74, 256)),
        ("no marker", PLAIN + "\nDuration: N/A, bitrate: N/A", (-11.5, -3.25, None)),
        ("silent", LOG.replace("-9.31", "-inf"), (float("-inf"), 0.74, None)),
        ("nothing", "no data", (None, None, None)),
        ("unquoted", PLAIN.replace('"-11.50"', "-11.50"), (None, None, None)),
        ("one value", '{"input_i" : "-11.50"}', (None, None, None)),
        ("marker without object", PLAIN + "\n[Parsed_loudnorm_0 @ 0x1] cut off", (-11.5, -3.25, None)),
        ("object never closed", PLAIN + '\n[Parsed_loudnorm_0 @ 0x1] {"x": "y"', (-11.5, -3.25, None)),
        ("broken object", PLAIN + "\n[Parsed_loudnorm_0 @ 0x1] {broken}", (None, None, None)),
        ("two objects", LOG + PLAIN, (-9.31, 0.74, None)),
        ("last of two", PLAIN + PLAIN.replace("3.25", "4.5"), (-11.5, -4.5, None)),
        ("nested", LOG.replace("{\n", '{"a": {"b": {"c": [{}]}}, '), (-9.31, 0.74, None)),
        ("long", LOG.replace("{\n", '{"pad": "' + "y" * 100_000 + '", '), (-9.31, 0.74, None)),
        ("many braces", LOG.replace("{\n", "{" + "".join(f'"k{i}": {{}}, ' for i in range(20_000))), (-9.31, 0.74, None)),
        ("not a line's start", "  Stream Duration: 1, bitrate: 99 kb/s\n\t Duration: 2, bitrate: 128 kb/s", (None, None, 128)),
        ("no blank", "Duration: 2, bitrate: 128kb/s", (None, None, None)),
        ("null", None, (None, None, None)),
    ]
    parsed = loudness.parse_logs(spark.createDataFrame([x[:2] for x in logs], "name string, log string"))
    assert {r["name"]: tuple(r)[1:] for r in parsed.collect()} == {name: found for name, _, found in logs}
    assert {r["reason"] for r in loudness.rejects(parsed).where("name = 'silent'").collect()} == {"not_finite"} and loudness.rejects(parsed).where("reason = 'no_measurement'").count() == 7
    assert loudness.accepted(parsed).count() == 9


def test_probes(spark):
    texts = ["{}", '{"streams": []}', "nonsense", '{"streams": [{"codec_name": "mp3", "sample_rate": "44100", "bit_rate": "319500"}, {"codec_name": "png"}]}', '{"streams": [{}], "format": {"bit_rate": "64000"}}', '{"streams": [{"codec_name": "aac", "bit_rate": " 5"}], "format": {"bit_rate": "64000"}}', None]
    probes = convert.parse_probes(spark.createDataFrame(list(enumerate(texts)), "track_id int, json string"))
    assert [r["has_stream"] for r in probes.orderBy("track_id").collect()] == [False, False, False, True, True, True, False]
    rows = convert.actions(spark.createDataFrame([(i,) for i in range(8)], "track_id int"), probes, ("track_id",)).orderBy("track_id").collect()
    assert [(r["action"], r["bitrate_kbps"]) for r in rows] == [(None, None)] * 3 + [("Copy", 320), ("Reencode", 64), ("ReencodeLossy", None)] + [(None, None)] * 2


def test_gain_thresholds(spark):
    rows = [("mp3", -5.1, 320), ("mp3", -1.7, 320), ("flac", -0.54, None), ("flac", -0.56, None), ("m4a", -2.0, None), ("ogg", -1.0, None)]
    plan = loudness.gain_plan(spark.createDataFrame(rows, "ext string, input_tp double, kbps int"))
    assert [(r["gain_method"], round(r["effective_gain"], 2), r["lossless_gain_steps"]) for r in plan.collect()] == [("Mp3Lossless", 4.5, 3), ("Mp3Reencode", 1.2, 0), ("None", 0.0, 0), ("FfmpegLossless", 0.06, 0), ("AacLossless", 1.5, 1), ("FfmpegLossless", 0.5, 0)]
    with pytest.raises(ValueError):
        loudness.TpTarget.chosen(-1.0, split=True)


def test_report_csv(spark, tmp_path):
    rows = [("c", "x.mp3", "mp3", -3.5, -9.96, 320), ("d", "y.flac", "flac", -3.5, -9.0, None), ("d", "z.flac", "flac", 0.0, -9.0, None)]
    plan = loudness.gain_plan(spark.createDataFrame(rows, "collection_id string, filename string, ext string, input_tp double, input_i double, kbps int").repartition(3))
    report.write_csv(plan, str(tmp_path / "r"), by=("collection_id",))
    assert sorted(len(list(x.glob("*.csv"))) for x in (tmp_path / "r").glob("collection_id=*")) == [1, 1]
    back = spark.read.csv(str(tmp_path / "r"), header=True).orderBy("Filename").collect()
    assert [tuple(r) for r in back] == [("x.mp3", "MP3", "320", "-10.0", "-3.5", "-0.5", "+3.0", "native", "+3.0", "c"), ("y.flac", "Lossless", "-", "-9.0", "-3.5", "-0.5", "+3.0", "ffmpeg", "+3.0", "d")]


def named_one_by_one(rows):
    taken, out = set(), []
    for folder, pos, own in sorted(rows):
        made, n = f"{own}.mp3", 1
        while (folder, made.lower()) in taken:
            n += 1
            made = f"{own} ({n}).mp3"
        taken.add((folder, made.lower()))
        out.append(made)
    return out


def test_file_names(spark):
    """Random folders against one row after the other: numbers in stems on several levels, either case, gaps between places."""
    rng = random.Random(2)
    stems = lambda: rng.choice(["drum", "DRUM", "Ümlaut", "ümlaut"]) + "".join(f" ({rng.choice([0, 1, 2, 2, 3, 4, '02'])})" for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])))
    rows = [(d, p * 3 + rng.randint(0, 2), stems()) for d in range(120) for p in range(rng.randint(1, 16))]
    rows += [(200, p, "same" if p % 3 else f"same ({p})") for p in range(300)]
    df = spark.createDataFrame([(d or None, p, f"/in/{p}/{x}.wav", "n", "w") for d, p, x in rows], "out_dir int, pos int, path string, name string, w_key string").repartition(3)
    names = [r["filename"] for r in convert.plan_filenames(df).orderBy("out_dir", "pos").collect()]
    assert names == named_one_by_one(rows)
    assert sorted(r["filename"] for r in convert.plan_filenames(df, keep=["pos", "w_key"]).collect()) == sorted(names)
    odd = [(1, "/x/.aiff", "n"), (2, "/x/a?b.flac", "n"), (3, "/x/A_B.wav", "n"), (4, None, "spare: name"), (5, "", None), (6, "/x/ (2).wav", "n")]
    df = spark.createDataFrame([(1, *x) for x in odd], "out_dir int, pos int, path string, name string")
    assert [r["filename"] for r in convert.plan_filenames(df).orderBy("pos").collect()] == [".aiff.mp3", "a_b.mp3", "A_B (2).mp3", "spare_ name.mp3", None, " (2).mp3"]
    assert convert.plan_filenames(df.limit(0)).count() == 0


def test_file_names_from_stems(spark):
    """Stems made beforehand give the same names, with and without numbers among them; no folder and an empty one are two."""
    rows = [(f, p, path, "n") for f in (None, "", "x") for p, path in enumerate(["/i/a.wav", "/j/A.mp3", "/i/b?.wav", None, "/k/b_", "/i/a.b.c"])]
    for more in ([], [("x", 9, "/i/a (2).wav", "n")], [("x", -1, "/i/a (2).wav", "n")]):
        df = spark.createDataFrame(rows + more, "out_dir string, pos int, path string, name string").repartition(3)
        made = df.withColumn("stem", convert.safe_stem(F.col("path"), F.col("name"))).drop("path", "name")
        plain, safe = (sorted(map(tuple, x.select("filename", "pos", F.coalesce("out_dir", F.lit("none"))).collect())) for x in (convert.plan_filenames(df), convert.plan_filenames(made, safe="stem", among=made)))
        assert plain == safe
        assert [sum(n == "a.mp3" for n, *_ in safe), sum(n == "A (2).mp3" for n, *_ in safe), sum(n == "b_ (2).mp3" for n, *_ in safe)] == [3, 2 if more and more[0][1] < 0 else 3, 3]


MARKERS = (".keep-out",)


def test_scan_and_inputs(spark):
    paths = ["/m/a/x.mp3", "/m/a/._x.mp3", "/m/b/.keep-out", "/m/b/y.mp3", "/m/b/c/z.wav", "/m/t.txt", "/m/a-b/q.flac", "/m/_i.mp3"]
    df = spark.createDataFrame([("c", p) for p in paths], "collection_id string, path string")
    assert sorted(r["path"] for r in files.scan_audio(files.prune_backups(df, "/m", MARKERS)).collect()) == ["/m/_i.mp3", "/m/a-b/q.flac", "/m/a/x.mp3"]
    assert sorted(r["path"] for r in files.scan_audio(files.prune_backups(df, "/m/b", MARKERS)).collect()) == sorted(["/m/_i.mp3", "/m/a-b/q.flac", "/m/a/x.mp3", "/m/b/y.mp3", "/m/b/c/z.wav"])
    given = lambda *names: spark.createDataFrame([("c", n) for n in names], "collection_id string, input string")
    found, unmatched = files.resolve_inputs(df, given("/m/a", "/m/*.mp3", "/m/a-?", "/x/*.mp3", "/m/t.txt"), MARKERS)
    assert [r["path"] for r in found.orderBy("parts").collect()] == ["/m/_i.mp3", "/m/a/x.mp3", "/m/a-b/q.flac"]
    assert [r["input"] for r in unmatched.collect()] == ["/x/*.mp3"]
    for name, expected in (("/", ["/m/_i.mp3", "/m/a/x.mp3", "/m/a-b/q.flac"]), ("/m/b/", ["/m/b/c/z.wav", "/m/b/y.mp3"]), ("/**/z.*", ["/m/b/c/z.wav"]), ("/m/[!b]/*.mp3", ["/m/a/x.mp3"]), ("/*/a*", ["/m/a/x.mp3", "/m/a-b/q.flac"])):
        assert [r["path"] for r in files.resolve_inputs(df, given(name), MARKERS)[0].orderBy("parts").collect()] == expected, name
    loose = spark.createDataFrame([("c", p) for p in ("one.mp3", "d/two.mp3", "/three.mp3")], "collection_id string, path string")
    for name, expected in (("*.mp3", ["one.mp3"]), ("*/*.mp3", ["d/two.mp3"]), ("/*.mp3", ["/three.mp3"]), ("/", ["/three.mp3"]), ("d", ["d/two.mp3"]), ("one.mp3", ["one.mp3"])):
        assert [r["path"] for r in files.resolve_inputs(loose, given(name))[0].collect()] == expected, name
    other = df.withColumn("collection_id", F.lit("other"))
    assert files.resolve_inputs(other, given("/m/a"), MARKERS)[0].count() == 0  # libraries don't mix


def test_common_bases(spark):
    for paths, base, targets in (
        (["/m/a/x.mp3", "/m/b/y.mp3"], "/m", ["/m/backup/a/x.mp3", "/m/backup/b/y.mp3"]), (["/m/a/x.mp3"], "/m/a", ["/m/a/backup/x.mp3"]), (["/x/a.mp3", "/y/a.mp3"], "/", ["/backup/x/a.mp3", "/backup/y/a.mp3"]),
        (["/a.mp3", "/y/a.mp3"], "/", ["/backup/a.mp3", "/backup/y/a.mp3"]), (["x/a.mp3", "y/a.mp3"], "", ["backup/x/a.mp3", "backup/y/a.mp3"]), (["/x/a.mp3", "y/a.mp3"], "", ["backup/a.mp3", "backup/y/a.mp3"]), (["/m/ab/x", "/m/a/x"], "/m", ["/m/backup/ab/x", "/m/backup/a/x"]),
    ):
        df = spark.createDataFrame([("c", p) for p in paths], "collection_id string, path string")
        assert files.common_base(df).first()["base"] == base, paths
        assert sorted(r["backup_path"] for r in files.backup_manifest(df).collect()) == sorted(targets), paths
        assert sorted(r["backup_path"] for r in files.backup_manifest(df, backup_dir="/safe/").collect()) == sorted("/safe/" + t.split("backup/", 1)[1] for t in targets)


def library(rng, n_tracks, depth):
    """A document with tracks under odd ids, some of them twice, and lists that overlap, in folders down to depth; and what is in it."""
    ids = [f"k{rng.randint(10, 99)}-{i % 17}" if i % 4 else str(rng.randint(5000, 9000)) for i in range(n_tracks)]
    keys = [rng.choice(["4A", "11B", "7a", "x", ""]) for _ in ids]
    track = '<TRACK TrackID="{}" Name="Song &lt;{}&gt;" Tonality="{}" AverageBpm="{}" Location="file://localhost/in/{}.wav" Mood="m{}">{}</TRACK>'
    body = "".join(track.format(t, i, k, 90 + i % 7, i, i, '<TEMPO Bpm="1"/><POSITION_MARK Num="0"/>' * (i % 3)) for i, (t, k) in enumerate(zip(ids, keys, strict=True)))
    lists = []

    def folder(level, path):
        own = [f"set {len(lists)}", f"set {len(lists) // 3}"]
        text = ""
        for name in own:
            held = rng.choices(ids, k=rng.randint(0, 5))
            lists.append(((*path, name), held))
            text += f'<NODE Name="{name}" Type="1" KeyType="0" Entries="{len(held)}">' + "".join(f'<TRACK Key="{x}"/>' for x in held) + "</NODE>"
        return text if level == depth else text + f'<NODE Name="deep {level}" Type="0">{folder(level + 1, (*path, f"deep {level}"))}</NODE>'

    tree = folder(1, ())
    return f'<DJ_PLAYLISTS><COLLECTION Entries=" {n_tracks}">{body}</COLLECTION><PLAYLISTS><NODE Name="Top" Type="0" Count="x">{tree}</NODE></PLAYLISTS></DJ_PLAYLISTS>', ids, lists


COLLECTION = "collection_id string, xml string"


def held_lists(spark, elements):
    """(collection, path, track ids in order) of all playlists."""
    lists, items = xml.playlists(elements).collect(), {}
    for r in xml.entries(elements).orderBy("pos").collect():
        items.setdefault((r["collection_id"], r["playlist_ord"]), []).append(r["track_id"])
    return sorted((r["collection_id"], tuple(r["path"]), items.get((r["collection_id"], r["playlist_ord"]), [])) for r in lists)


def test_reading_documents_of_any_depth(spark):
    """Deep, flat, broken and missing documents in one run: what can be read is read, the others are rejects with their reason."""
    rng = random.Random(7)
    deep, ids, lists = library(rng, 40, 30)
    flat, flat_ids, flat_lists = library(rng, 3, 1)
    cases = [("deep", deep), ("flat", flat), ("cut", deep[:-30]), ("twice", flat + flat), ("null", None), ("blank", ""), ("bad", flat.replace("&lt;", "&none;", 1))]
    elements = xml.parse_collections(spark.createDataFrame(cases, COLLECTION)).cache()
    assert {r["collection_id"]: r["reason"].split(" at byte")[0] for r in xml.rejects(elements).collect()} == {
        "cut": "malformed: unclosed token", "twice": "malformed: junk after document element", "null": "no document", "blank": "malformed: no element found", "bad": "malformed: undefined entity",
    }
    assert held_lists(spark, elements) == sorted([("deep", path, held) for path, held in lists] + [("flat", path, held) for path, held in flat_lists])
    assert max(r["depth"] for r in xml.nodes(elements).collect()) == 30
    own = xml.tracks(elements).orderBy("collection_id", "doc_pos").collect()
    assert [r["track_id"] for r in own] == ids + flat_ids and [r["doc_pos"] for r in own] == [*range(40), *range(3)]
    assert [(r["name"], r["attrs"]["Mood"], len(r["tempos"]), len(r["position_marks"])) for r in own[:40]] == [(f"Song <{i}>", f"m{i}", i % 3, i % 3) for i in range(40)]
    with pytest.raises(Exception, match="malformed"):
        xml.parse_collections(spark.createDataFrame(cases, COLLECTION), strict=True).count()
    assert xml.parse_collections(spark.createDataFrame([], COLLECTION)).count() == 0


def test_nodes_that_close_themselves_and_nest(spark):
    tree = (
        '<NODE Name="r" Type="0"><NODE Name="p" Type="1" KeyType="0"><TRACK Key="1"/><TRACK Key="2"></TRACK><TRACK NoKey=""/><NODE Name="q" Type="1" KeyType="0"><TRACK Key="3"/></NODE><TRACK Key="4"/></NODE>'
        '<NODE Name="p" Type="1" KeyType="1"/><NODE Name="s" Type="1" KeyType="0"></NODE><NODE Type="1"/></NODE><NODE Name="top" Type="1" KeyType="0"><TRACK Key="9"/></NODE>'
    )
    elements = xml.parse_collections(spark.createDataFrame([("c", f"<X><TRACK Key='0'/><PLAYLISTS>{tree}</PLAYLISTS><NODE Name='outside' Type='1'/></X>")], COLLECTION)).cache()
    assert held_lists(spark, elements) == [("c", ("",), []), ("c", ("p",), []), ("c", ("p",), ["1", "3", "4"]), ("c", ("s",), [])]
    every = spark.createDataFrame([("c", "p")], "collection_id string, target string")
    first, last = (playlists.find_target(xml.playlists(elements), every, match).first() for match in ("first", "last"))
    assert first["status"] == last["status"] == "ok" and first["playlist_ord"] == last["playlist_ord"]  # the later p closes itself


def test_sorted_export_reads_back(spark):
    """All documents again with a folder of their sorted lists, at any depth; read back, they hold what they held and the new folder."""
    rng = random.Random(8)
    texts, lists = [], {}
    for name, depth in (("a", 1), ("b", 12), ("c", 3)):
        text, _, lists[name] = library(rng, 25, depth)
        texts.append((name, text))
    docs = spark.createDataFrame([*texts, ("broken", texts[0][1][:50])], COLLECTION)
    elements = xml.parse_collections(docs).cache()
    chosen, _ = playlists.choose(xml.playlists(elements), docs)
    ordered = playlists.harmonic_sort(xml.entries(elements), playlists.last_wins(xml.tracks(elements)), chosen)
    new = xml.export_sorted(docs, ordered, chosen, "Tonight & on").cache()
    assert sorted(r["collection_id"] for r in new.collect()) == ["a", "b", "c"]
    again = xml.parse_collections(new).cache()
    back = held_lists(spark, again)
    for name, own in lists.items():
        assert [x[1:] for x in back if x[0] == name and x[1][0] != "Tonight & on"] == sorted(own)
        made = [x for x in back if x[0] == name and x[1][0] == "Tonight & on"]
        assert sorted((x[1][1], sorted(x[2])) for x in made) == sorted((path[-1], sorted(held)) for path, held in own)
    root = xml.nodes(again).where("parent_ord IS NULL").select("count").distinct().collect()
    assert [r["count"] for r in root] == ["1"] and xml.nodes(again).where("collection_id = 'a' AND name = 'Tonight & on'").first()["count"] == str(len(lists["a"]))


def test_converted_export_reads_back(spark):
    """New tracks take over what is theirs, and get what is recomputed; an id that occurs twice counts as the last one."""
    rng = random.Random(9)
    text, ids, lists = library(rng, 30, 4)
    docs = spark.createDataFrame([("c", text)], COLLECTION)
    elements = xml.parse_collections(docs).cache()
    own = xml.tracks(elements)
    path, held = max((x for x in lists if len(set(x[1])) == len(x[1])), key=lambda x: len(x[1]))
    assert len(held) > 2
    one = xml.playlists(elements).where(F.array_join("path", "/") == "/".join(path))
    sources = convert.source_tracks(xml.entries(elements).join(one.select("collection_id", "playlist_ord"), ["collection_id", "playlist_ord"]), own).withColumn("path", decode_location(F.col("location"))).withColumn("out_dir", F.lit("/done"))
    last = {t: i for i, t in enumerate(ids)}
    sizes = spark.createDataFrame([("c", f"/done/{last[t]}.mp3", 1000 + last[t]) for t in held], "collection_id string, path string, size long")
    made = convert.new_tracks(convert.plan_filenames(sources), convert.max_track_id(own), sizes)
    new = xml.export_converted(docs, made, one.select("collection_id", "playlist_ord", F.lit("copy").alias("name")), "Safe").cache()
    again = xml.parse_collections(new.select("collection_id", "xml")).cache()
    rows = xml.tracks(again).orderBy("doc_pos").collect()
    start = max(int(t) for t in ids if t.isdigit())
    assert [r["track_id"] for r in rows] == ids + [str(start + 1 + i) for i in range(len(held))]
    for r, t in zip(rows[len(ids) :], held, strict=True):
        source = rows[last[t]]
        assert (r["name"], r["tonality"], r["attrs"]["Mood"], r["tempos"], r["position_marks"]) == (source["name"], source["tonality"], source["attrs"]["Mood"], source["tempos"], source["position_marks"])
        assert (r["location"], r["size"], r["kind"], r["bit_rate"], r["sample_rate"], r["comments"]) == (f"file://localhost/done/{last[t]}.mp3", str(1000 + last[t]), "MP3 File", "320", "44100", convert.MARKER)
    assert ("c", ("Safe", "copy"), [str(start + 1 + i) for i in range(len(held))]) in held_lists(spark, again)
    assert f'<COLLECTION Entries="{30 + len(held)}">' in new.first()["xml"]


RICH = """<?xml version="1.0" encoding="UTF-8"?>
<!-- </COLLECTION> --><DJ_PLAYLISTS Version="1.0.0"><PRODUCT Name="p" Company="ü"/><COLLECTION Entries="2"><TRACK TrackID="1" Name="A &amp; &quot;B&quot;" Album="x&#10;y" Rating="204" Size="5" Location="file://localhost/a.flac"><TEMPO Inizio="0.025" Bpm="120.00" Metro="4/4" Battito="1" Own="1"/><OTHER z='>'>t &lt; <![CDATA[</TRACK>]]></OTHER></TRACK><TRACK TrackID="2" Genre="g" Location="file://localhost/b.flac"/></COLLECTION><PLAYLISTS><NODE Type="0" Name="ROOT" Count="1" Extra="e"><NODE Name="L" Type="1" KeyType="0" Entries="2" Colour="c"><TRACK Key="2"/><TRACK Key="1"/></NODE></NODE></PLAYLISTS><HISTORY x="1"/></DJ_PLAYLISTS>"""


def test_exports_keep_what_the_tables_do_not_hold(spark):
    docs = spark.createDataFrame([("c", RICH)], COLLECTION)
    elements = xml.parse_collections(docs).cache()
    own, lists = xml.tracks(elements), xml.playlists(elements)
    ordered = playlists.harmonic_sort(xml.entries(elements), own, lists)
    text = xml.export_sorted(docs, ordered, lists.withColumn("name", F.try_element_at("path", F.lit(-1))), "S").first()["xml"]
    folder = '<NODE Name="S" Type="0" Count="1"><NODE Name="L" Type="1" KeyType="0" Entries="2"><TRACK Key="2"/><TRACK Key="1"/></NODE></NODE>'
    assert text == RICH.replace('Count="1"', 'Count="2"').replace("</NODE></NODE>", "</NODE>" + folder + "</NODE>")

    sources = convert.source_tracks(xml.entries(elements), own).withColumn("path", decode_location(F.col("location"))).withColumn("out_dir", F.lit("/out"))
    made = convert.new_tracks(convert.plan_filenames(sources), convert.max_track_id(own))
    text = xml.export_converted(docs, made, lists.select("collection_id", "playlist_ord", F.lit("L").alias("name")), "F").first()["xml"]
    common = 'Kind="MP3 File" BitRate="320" SampleRate="44100" Comments="[cdjsafe]"'
    new = f'<TRACK TrackID="3" Genre="g" Location="file://localhost/out/b.mp3" {common}/><TRACK TrackID="4" Name="A &amp; &quot;B&quot;" Album="x&#10;y" Rating="204" Size="5" Location="file://localhost/out/a.mp3" {common}>' + RICH[RICH.index("<TEMPO") : RICH.index("<TRACK TrackID=\"2")]
    folder = '<NODE Name="F" Type="0" Count="1"><NODE Name="L" Type="1" KeyType="0" Entries="2"><TRACK Key="3"/><TRACK Key="4"/></NODE></NODE>'
    assert text == RICH.replace('Entries="2"><TRACK TrackID', 'Entries="4"><TRACK TrackID').replace("</COLLECTION><P", new + "</COLLECTION><P").replace('Count="1"', 'Count="2"').replace("</NODE></NODE>", "</NODE>" + folder + "</NODE>")
    assert xml.rewritten('<D><PLAYLISTS><NODE Name="R"/></PLAYLISTS></D>', "S", [], []) == '<D><PLAYLISTS><NODE Name="R" Count="1"><NODE Name="S" Type="0" Count="0"></NODE></NODE></PLAYLISTS></D>'


UNIT = "collection_id string, playlist_ord int"


def test_gate_and_counters(spark):
    entries = spark.createDataFrame([("c", 1, 1, "1"), ("c", 1, 2, "1"), ("c", 2, 1, "9"), ("c", 4, 1, "1"), ("c", 5, 1, "2"), ("c", 6, 1, "3")], UNIT + ", pos int, track_id string")
    tracks = spark.createDataFrame([("c", "1", 1, "file:///old"), ("c", "1", 4, "file:///m/1"), ("c", "2", 2, "file:///m/2"), ("c", "3", 3, "file:///m/3")], "collection_id string, track_id string, doc_pos int, location string")
    lists = spark.createDataFrame([("c", n) for n in range(1, 7)], UNIT)
    probes = convert.parse_probes(spark.createDataFrame([("c", str(n), '{"streams": [{"codec_name": "mp3"}]}' if n < 3 else "{}") for n in (1, 2, 3)], "collection_id string, track_id string, json string"))
    manifest = spark.createDataFrame([("c", "/m/1"), ("c", "/m/3")], "collection_id string, path string")
    own = convert.judged(entries, tracks, probes, manifest)
    assert {(r["playlist_ord"], r["failure"]) for r in own.collect()} == {(1, None), (2, "dangling"), (4, None), (5, "missing_source"), (6, "unprobed")}
    assert {r["playlist_ord"]: r["status"] for r in convert.gate(own, lists).collect()} == {1: "failed", 2: "failed", 3: "empty_playlist", 4: "ok", 5: "failed", 6: "failed"}
    with pytest.raises(ValueError):
        convert.gate(own, lists, strict=True)
    assert values(spark, [" 5 ", "x", None], lambda x: playlists.bumped(x, 2)) == ["7", "2", "2"]
    assert convert.source_tracks(entries, tracks).count() == 5  # an id that occurs twice doesn't multiply entries


def test_conversion_from_target_to_tracks(spark):
    lists = spark.createDataFrame([("c", 1, ["F", "A"], "0"), ("c", 2, ["F", "A"], "0"), ("c", 3, ["B"], "1"), ("c", 4, ["E"], "0"), ("c", 5, ["Late"], "0")], UNIT + ", path array<string>, key_type string")
    entries = spark.createDataFrame([("c", 1, 0, "1"), ("c", 2, 0, "2"), ("c", 2, 1, "1"), ("c", 5, 0, "1")], UNIT + ", pos int, track_id string")
    tracks = spark.createDataFrame([("c", str(n), n, f"file:///m/{n}.wav", "song", None, "1") for n in (1, 2)], "collection_id string, track_id string, doc_pos int, location string, name string, comments string, size string")
    probes = convert.parse_probes(spark.createDataFrame([("c", str(n), '{"streams": [{"codec_name": "flac"}]}') for n in (1, 2)], "collection_id string, track_id string, json string"))
    manifest = spark.createDataFrame([("c", f"/m/{n}.wav") for n in (1, 2)], "collection_id string, path string")
    finished = spark.createDataFrame([("c", f"/out/c/2/{n}.mp3", 50 + n) for n in (1, 2)], "collection_id string, path string, size long")
    targets = spark.createDataFrame([("c", t) for t in (" F / A", "B", "E", "Late", "none", " / ")], "collection_id string, target string")
    run = lambda wanted, **more: convert.convert_playlists(wanted, lists, entries, tracks, manifest, probes, finished, "/out", **more)
    status, made = run(targets)
    assert {r["target"]: (r["playlist_ord"], r["status"]) for r in status.collect()} == {" F / A": (2, "ok"), "B": (3, "wrong_key_type"), "E": (4, "empty_playlist"), "Late": (5, "unfinished"), "none": (None, "not_found"), " / ": (None, "empty_target")}
    assert [(r["playlist_ord"], r["pos"], int(r["new_id"]), r["size"], r["location"]) for r in made.orderBy("pos").collect()] == [(2, 0, 3, "52", "file://localhost/out/c/2/2.mp3"), (2, 1, 4, "51", "file://localhost/out/c/2/1.mp3")]
    with pytest.raises(ValueError):
        run(targets, strict=True)
    assert run(targets.where("target = ' F / A'"), strict=True)[1].count() == 2


def test_choosing_playlists(spark):
    lists = spark.createDataFrame([("c", 1, ["F", "A"], "0"), ("c", 2, ["F", "A"], "1"), ("c", 3, ["B"], "1"), ("d", 1, ["B"], "1")], UNIT + ", path array<string>, key_type string")
    every = spark.createDataFrame([("c",), ("d",), ("e",)], "collection_id string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    chosen, status = playlists.choose(lists, every)
    assert rows(chosen) == [("c", 1, "A")] and rows(status) == [("c", "ok"), ("d", "no_playlists"), ("e", "no_playlists")]
    chosen, status = playlists.choose(lists, every, " F/A ", "mine")
    assert rows(chosen) == [("c", 1, "mine")] and rows(status) == [("c", "ok"), ("d", "not_found"), ("e", "not_found")]
    assert rows(playlists.choose(lists, every, "B")[1]) == [("c", "wrong_key_type"), ("d", "wrong_key_type"), ("e", "not_found")]
    for target, name in ((None, "n"), (" / ", None)):
        with pytest.raises(ValueError):
            playlists.choose(lists, every, target, name)
    last = playlists.find_target(lists, every.withColumn("target", F.lit("F/A")), "last").where("collection_id = 'c'").first()
    assert (last["playlist_ord"], last["status"]) == (2, "wrong_key_type")


def test_planned_stream(spark, tmp_path):
    spark.createDataFrame([("a", "mp3", "Duration: 1, bitrate: 320 kb/s\n" + LOG), ("b", "mp3", "no data")], "name string, ext string, log string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, ext string, log string").parquet(str(tmp_path / "in"))
    run = planned_stream(stream).writeStream.format("memory").queryName("plans").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [(r["name"], r["gain_method"]) for r in spark.sql("SELECT * FROM plans").collect()] == [("a", "None")]


LOG_ROWS = "name string, ext string, log string"


def test_stream_that_stops_in_the_middle(spark, tmp_path):
    """Five batches; the third fails between its two writes. Started again, each log is there once, as a plan or a reject."""
    source, plans, rejected, state = (str(tmp_path / x) for x in ("in", "plans", "rejected", "state"))
    logs = [(f"n{i}", "mp3", ("no data" if i % 3 == 0 else LOG.replace("0.74", "-inf") if i % 3 == 1 else "Duration: 1, bitrate: 128 kb/s\n" + LOG.replace("0.74", "-4.00"))) for i in range(20)]
    for i in range(5):
        spark.createDataFrame(logs[i * 4 : i * 4 + 4], LOG_ROWS).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(LOG_ROWS).option("maxFilesPerTrigger", 1).parquet(source)

    def stops(batch):
        if batch == 2:
            raise RuntimeError("stopped")

    run = gain_sink(stream(), plans, rejected, state, after=stops).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="stopped"):
        run.awaitTermination(120)
    assert spark.read.parquet(rejected).select("batch").distinct().count() == 3 and spark.read.parquet(plans).select("batch").distinct().count() == 2
    gain_sink(stream(), plans, rejected, state).trigger(availableNow=True).start().awaitTermination(120)
    found = [(r["name"], r["gain_method"]) for r in spark.read.parquet(plans).collect()] + [(r["name"], r["reason"]) for r in spark.read.parquet(rejected).collect()]
    assert sorted(found) == sorted((name, ("no_measurement", "not_finite", "Mp3Lossless")[i % 3]) for i, (name, *_) in enumerate(logs))


def test_settings_of_libraries(spark):
    rows = [("a", None, None, None, None, None, None), ("b", -3.0, False, None, None, True, None), ("c", None, True, None, True, None, None), ("d", -3.0, True, None, None, None, None), ("e", None, None, True, True, None, None), ("f", None, None, None, None, True, True), ("g", -1.0, None, None, None, None, None), ("g", -1.0, None, None, None, None, None), (None, -9.0, None, None, None, None, None)]
    settings = spark.createDataFrame(rows, f"collection_id string, {loudness.SETTINGS}")
    found = {r["collection_id"]: tuple(r)[1:] for r in loudness.resolved_settings(settings).collect()}
    void = (None,) * 4
    assert found == {
        "a": (-0.5, None, True, False, "ok"), "b": (-3.0, None, True, True, "ok"), "c": (-0.5, -1.0, False, False, "ok"), "d": (*void, "target_and_split"), "e": (*void, "lossless_conflict"),
        "f": (*void, "reencode_conflict"), "g": (*void, "repeated"), None: (-9.0, None, True, False, "ok"),
    }
    files_ = [(c, ext, tp, kbps) for c in "abcdz" for ext, tp, kbps in (("mp3", -1.1, 320), ("mp3", -4.0, 128), ("wav", -2.0, None))]
    plan = loudness.gain_plan_by_settings(spark.createDataFrame(files_, "collection_id string, ext string, input_tp double, kbps int"), settings)
    rows = {c: [] for c in "abcdz"}
    for r in plan.orderBy("collection_id", "input_tp").collect():
        rows[r["collection_id"]].append((r["target_tp"], r["gain_method"], r["selected"]))
    assert rows["a"] == rows["z"] == [(-0.5, "Mp3Lossless", True), (-0.5, "FfmpegLossless", True), (-0.5, "Mp3Reencode", False)]
    assert rows["b"] == [(-3.0, "Mp3Reencode", True), (-3.0, "None", False), (-3.0, "None", False)]
    assert rows["c"] == [(-1.0, "Mp3Lossless", False), (-0.5, "FfmpegLossless", False), (-0.5, "Mp3Reencode", False)]
    assert rows["d"] == [(None, None, None)] * 3


def test_counts_that_come_with_the_write(spark, tmp_path):
    """One job writes and counts; its numbers are those of the summary."""
    rows = [("flac", -3.0, None), ("mp3", -5.0, 320), ("m4a", -9.0, None), ("mp3", -1.0, 320), ("aac", 0.0, None)] * 7
    plan = loudness.gain_plan(spark.createDataFrame(rows, "ext string, input_tp double, kbps int").repartition(3))
    watched, seen = loudness.observed(plan)
    spark.sparkContext.setJobGroup("writes", "one write")
    watched.write.parquet(str(tmp_path / "plan"))
    counted = seen.get
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("writes")
    spark.sparkContext.setJobGroup("other", "")
    assert counted == loudness.method_summary(plan, ()).first().asDict() | {"failures": 0} and counted["Mp3Reencode"] == 7
    assert len(jobs) == len(spark.sparkContext.statusTracker().getJobIdsForGroup("writes")) and spark.read.parquet(str(tmp_path / "plan")).count() == 35
    acted, seen = loudness.observed_actions(spark.createDataFrame([("Copy",), ("Copy",), (None,)], "action string"))
    acted.write.parquet(str(tmp_path / "acts"))
    assert seen.get == {"Copy": 2, "ReencodeLossy": 0, "Reencode": 0, "failures": 1}


def test_places_in_large_lists(spark):
    """A list with most of the entries is dealt to many ranges and placed like the windows place it, nulls and ties included."""
    rng = random.Random(5)
    tracks = spark.createDataFrame([("c", str(i), rng.choice(["4A", "9B", "x", None]), rng.choice(["120", "121.5", "", None])) for i in range(50)], "collection_id string, track_id string, tonality string, average_bpm string")
    entries = spark.createDataFrame([("c", 7 if i % 4 else i, i, str(rng.randint(0, 60))) for i in range(6000)], UNIT + ", pos int, track_id string").repartition(6)
    lists = spark.createDataFrame([("c", n, "0") for n in range(0, 6000)], UNIT + ", key_type string")
    shown = lambda df: sorted((r["playlist_ord"], r["new_pos"], r["pos"], r["track_id"]) for r in df.collect())
    small = shown(playlists.harmonic_sort(entries, tracks, lists))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows would be one range
    try:
        assert shown(playlists.harmonic_sort(entries, tracks, lists, most=1000)) == small == shown(playlists.harmonic_sort(entries, tracks, lists, most=10**6))
        big = entries.where("playlist_ord = 7")
        placed = ranked(big, ["collection_id"], [F.col("track_id").asc(), F.col("pos").desc()], "place")
        assert [r["place"] for r in placed.orderBy("track_id", F.desc("pos")).collect()] == list(range(1, big.count() + 1))
        at = F.spark_partition_id()
        assert big.repartitionByRange("collection_id", "track_id", "pos").groupBy(at).count().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_order_of_found_files(spark):
    """Files come in the order of their paths part by part: a folder before a name that begins like it."""
    paths = ["/m/a/x.mp3", "/m/a b/x.mp3", "/m/a.mp3", "/m/a/b/c.wav", "/m/ab.mp3", "/m/A/z.mp3", "/m/é.mp3", "/m/a-/x.mp3"]
    found, _ = files.resolve_inputs(spark.createDataFrame([("c", p) for p in paths], "collection_id string, path string"), spark.createDataFrame([("c", "/m")], "collection_id string, input string"))
    assert [r["path"] for r in found.orderBy("parts").collect()] == sorted(paths, key=lambda p: [x.encode() for x in p.split("/")])


def test_many_files_of_one_folder_named_one_by_one(spark):
    """Named files meet by their paths, not by their folder, which would make 1.6 thousand million pairs here."""
    manifest = spark.range(0, 40000, 1, 2).select(F.lit("c").alias("collection_id"), F.concat(F.lit(f"/m/x/{'long name ' * 8}"), "id", F.lit(".mp3")).alias("path"))
    inputs = manifest.select("collection_id", F.when(F.col("path").endswith("7.mp3"), F.concat("path", F.lit(".none"))).otherwise(F.col("path")).alias("input"))
    began = time.time()
    found, unmatched = files.resolve_inputs(manifest, inputs)
    assert (found.count(), unmatched.count()) == (36000, 4000)
    assert time.time() - began < 60


def test_one_collection_is_not_met_in_one_task(spark):
    """What has one row a collection is broadcast, also where the session broadcasts nothing by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = spark.createDataFrame([("c", 0, None, "R", "0", None, "1", None), ("c", 1, 0, "a", "1", "0", None, "0")], "collection_id string, node_ord long, parent_ord long, name string, type string, key_type string, count string, entries string")
        counts = spark.createDataFrame([("c", 1, 3)], "collection_id string, playlist_ord long, n long")
        plan = playlists.sorted_nodes(nodes, counts)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_partitions_follow_the_tables(spark, monkeypatch):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    monkeypatch.setattr(fixtures, "SHARE", 1000)
    wanted = fixtures.spread(spark, "/root/testdata/sf0.001", "entries")
    assert wanted > 50 and spark.conf.get(name) == str(wanted)
    monkeypatch.setattr(fixtures, "SHARE", 1 << 40)
    fixtures.spread(spark, "/root/testdata/sf0.001", "entries")
    assert spark.conf.get(name, None) is None
    spark.conf.set(name, "7")  # the caller's own
    monkeypatch.setattr(fixtures, "SHARE", 1000)
    fixtures.spread(spark, "/root/testdata/sf0.001", "entries")
    assert spark.conf.get(name) == "7"
    spark.conf.unset(name)


def test_half_of_all_rows_are_placed_over_many_tasks(spark):
    """The view has no window over a whole list; its rows are those of the view's SQL."""
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").createOrReplaceTempView("half_lineitem")
    made = fixtures.view(spark, "/root/testdata/sf0.001", "half_entries")
    windows = [line for line in made._jdf.queryExecution().executedPlan().toString().split("\n") if "row_number" in line and "Window" in line]
    assert windows and all("w_range" in line for line in windows)
    plain = spark.sql(fixtures.VIEWS["half_entries"].replace("@lineitem", "half_lineitem"))
    shown = lambda df: sorted(map(tuple, df.select("playlist_ord", "pos", "track_id").collect()))
    assert shown(made) == shown(plain)


def test_chosen_elements_are_those_of_the_whole(spark):
    """Kinds, attributes and children that are asked for, in one pass and in two, against all elements; a cut document is one reject."""
    text = """<D><COLLECTION><TRACK TrackID="1" Name="it's > 'x'"><TEMPO Bpm="1"/><A><B c='"'/></A></TRACK><TRACK/></COLLECTION><PLAYLISTS><NODE Name="R"><NODE Name='a">"' Type="1" KeyType="0"><TRACK Key="1"/><TRACK Key="2"></TRACK><TRACK other="'>'" Key='3'/></NODE></NODE></PLAYLISTS></D>"""
    docs = spark.createDataFrame([("c", text), ("cut", text[:-30]), ("none", None)], COLLECTION)
    full = [r.asDict(True) for r in xml.parse_collections(docs).collect()]
    assert [(r["kind"], r["seq"], r["ord"]) for r in full if r["collection_id"] == "c"] == [("track", 0, 2), ("track", 1, 6), ("node", 0, 8), ("node", 1, 9), ("entry", 0, 10), ("entry", 1, 12)]
    assert [(c["tag"], c["attrs"]) for c in full[0]["children"]] == [("TEMPO", {"Bpm": "1"}), ("A", {}), ("B", {"c": '"'})]
    assert [(r["collection_id"], r["kind"]) for r in full[6:]] == [("cut", "reject"), ("none", "reject")]
    some = [r.asDict(True) for r in xml.parse_collections(docs, kinds=("track", "entry"), attrs=("Key", "TrackID"), children=False).collect()]
    want = [r | ({"attrs": {k: v for k, v in r["attrs"].items() if k in ("Key", "TrackID")}, "children": [] if r["kind"] == "track" else None} if r["attrs"] is not None else {}) for r in full if r["kind"] != "node"]
    assert some == want
    pieces = lambda t: lambda: (t.encode()[i : i + 7] for i in range(0, len(t), 7))
    one, two = ([b for t in (text, text[:-30]) for b in xml.scanned(pieces(t), size, "UTF-8")] for size in (0, xml.WHOLE + 1))
    assert one == two and [b.num_rows for b in one] == [6, 1]
