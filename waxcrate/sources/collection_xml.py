"""Collection documents: XML texts to tables of tracks, playlists, entries and nodes, and exports of the texts with more in them.

The texts are read as parser events, so playlist trees may have any depth, and one document that can't be read is a reject with its reason,
not the end of a job. Attributes and children of tracks are carried whole, as a map and a list.

An export is the original text with new tracks and nodes put in, and counters raised: what the tables don't hold (other attributes,
children and top-level elements) stays as it is. A new track is its source's text with the recomputed attributes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that the parser takes at a time, elements of a batch, and bytes of a document that is read in one pass.
CHUNK, BATCH, WHOLE = 1 << 12, 5000, 1 << 24
TRACK_FIELDS = {
    "track_id": "TrackID", "name": "Name", "artist": "Artist", "kind": "Kind", "size": "Size", "total_time": "TotalTime", "average_bpm": "AverageBpm", "bit_rate": "BitRate",
    "sample_rate": "SampleRate", "comments": "Comments", "location": "Location", "tonality": "Tonality",
}
#: Attributes of a new track that aren't its source's.
RECOMPUTED = {"TrackID": "new_id", "Location": "location", "Kind": "kind", "Size": "size", "BitRate": "bit_rate", "SampleRate": "sample_rate", "Comments": "comments"}

_ATTRS = pa.map_(pa.string(), pa.string())
ELEMENT = pa.schema([
    ("kind", pa.string()), ("ord", pa.int64()), ("seq", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("path", pa.list_(pa.string())), ("playlist", pa.bool_()), ("closed", pa.bool_()), ("attrs", _ATTRS),
    ("children", pa.list_(pa.struct([("tag", pa.string()), ("attrs", _ATTRS)]))), ("reason", pa.string()),
])
ELEMENTS = (
    "kind string, ord long, seq long, parent long, depth int, path array<string>, playlist boolean, closed boolean, attrs map<string,string>, "
    "children array<struct<tag:string,attrs:map<string,string>>>, reason string"
)
_START_TAG = re.compile(rb"""<(?:[^>"']|"[^"]*"|'[^']*')*>""")


#: Kinds of elements; rejects come with any choice of them.
KINDS = ("track", "node", "entry")


class Rows:
    """Elements as columns of ELEMENT: a document has too many of them for a dict each."""

    FIELDS = ("kind", "ord", "seq", "parent", "depth", "path", "playlist", "closed")

    def __init__(self):
        self.single: list[tuple] = []  # in the order of FIELDS
        self.flat: list[list[str]] = []
        self.children: list[list[tuple[str, list[str]]] | None] = []

    def add(self, single: tuple, flat: list[str], children: list[tuple[str, list[str]]] | None = None) -> None:
        self.single.append(single)
        self.flat.append(flat)
        self.children.append(children)

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.single, strict=True) if self.single else [()] * len(self.FIELDS)
        held = [pa.array(v, ELEMENT.field(name).type) for name, v in zip(self.FIELDS, columns, strict=True)]
        inner = [c for cs in self.children if cs for c in cs]
        offsets, at = [], 0
        for cs in self.children:
            offsets.append(None if cs is None else at)
            at += len(cs) if cs else 0
        shape = ELEMENT.field("children").type
        structs = pa.StructArray.from_arrays([pa.array([t for t, _ in inner], pa.string()), _maps([f for _, f in inner])], fields=list(shape.value_type))
        children = pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), structs, type=shape)
        return pa.RecordBatch.from_arrays([*held, _maps(self.flat), children, pa.nulls(len(self.flat), pa.string())], schema=ELEMENT)


def _maps(flat: list[list[str]]) -> pa.MapArray:
    """Maps from lists of names and values in turn."""
    every, offsets = [x for f in flat for x in f], [0]
    for f in flat:
        offsets.append(offsets[-1] + len(f) // 2)
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(every[::2], pa.string()), pa.array(every[1::2], pa.string()))


class Scanner:
    """Elements of one document from its bytes, fed piece by piece: of whole elements only, those of the kinds, with the attributes attrs (None: all)."""

    def __init__(self, encoding: str | None, kinds: tuple[str, ...] = KINDS, attrs: tuple[str, ...] | None = None, children: bool = True):
        self.parser = expat.ParserCreate(encoding)
        self.parser.ordered_attributes = True
        self.parser.StartElementHandler, self.parser.EndElementHandler = self._start, self._end
        self.tracks, self.other, self.entries = "track" in kinds, "node" in kinds, "entry" in kinds
        self.wanted, self.with_children = None if attrs is None else frozenset(attrs), children
        self.rows = Rows()
        self.depth, self.count, self.numbers = 0, 0, {"track": 0, "node": 0}
        self.in_collection = self.in_playlists = False
        self.track_depth: int | None = None  # of the track whose children are read
        self.track: tuple | None = None  # that track
        self.nodes: list[tuple[int, str]] = []  # open nodes: number and name
        self.current: tuple[int, int] | None = None  # the open playlist: its number, and how many nodes are open in it
        self.pos = 0

    def feed(self, data: bytes, last: bool) -> None:
        self.parser.Parse(data, last)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, Rows()
        return rows.batch()

    def _own(self, flat: list[str]) -> list[str]:
        return flat if self.wanted is None else [x for i in range(0, len(flat), 2) if flat[i] in self.wanted for x in (flat[i], flat[i + 1])]

    def _start(self, name: str, flat: list[str]) -> None:
        if self.track_depth is not None:
            if self.tracks and self.with_children:
                self.track[-1].append((name, flat))
        elif name == "COLLECTION":
            self.in_collection = True
        elif name == "PLAYLISTS":
            self.in_playlists = True
        elif name == "TRACK" and self.in_collection:
            self.track_depth = self.depth
            if self.tracks:
                self.track = (self.count, self.numbers["track"], self._own(flat), [])
            self.numbers["track"] += 1
        elif name == "TRACK" and self.current and "Key" in flat[::2] and self._closed():
            if self.entries:
                self.rows.add(("entry", self.count, self.pos, self.current[0], self.depth, None, None, None), self._own(flat))
            self.pos += 1
        elif name == "NODE" and self.in_playlists:
            self._node(dict(zip(flat[::2], flat[1::2], strict=True)), flat)
        self.depth += 1
        self.count += 1

    def _node(self, own: dict[str, str], flat: list[str]) -> None:
        parent = self.nodes[-1][0] if self.nodes else None
        self.nodes.append((self.count, own.get("Name", "")))
        closed = self._closed()
        playlist = own.get("Type") == "1" and len(self.nodes) > 1 and (closed or self.current is None)
        if playlist and not closed:
            self.current, self.pos = (self.count, len(self.nodes)), 0
        if self.other:
            self.rows.add(("node", self.count, self.numbers["node"], parent, self.depth, [n for _, n in self.nodes[1:]], playlist, closed), self._own(flat))
        self.numbers["node"] += 1

    def _closed(self) -> bool:
        """Whether the start tag at hand closes itself; the parser holds the whole tag."""
        held = self.parser.GetInputContext()
        end = held.find(b">")
        if held.find(b"'", 0, end) < 0 and held.count(b'"', 0, end) % 2 == 0:  # that > is in no quotes
            return held[end - 1 : end] == b"/"
        return _START_TAG.match(held)[0].endswith(b"/>")

    def _end(self, name: str) -> None:
        self.depth -= 1
        if self.track_depth is not None:
            if self.depth == self.track_depth:
                if self.tracks:
                    at, seq, flat, children = self.track
                    self.rows.add(("track", at, seq, None, self.depth, None, None, None), flat, children)
                self.track = self.track_depth = None
        elif name == "COLLECTION":
            self.in_collection = False
        elif name == "PLAYLISTS":
            self.in_playlists = False
        elif name == "NODE" and self.in_playlists and self.nodes:
            if self.current and self.current[1] == len(self.nodes):
                self.current = None
            self.nodes.pop()


def _reason(e: expat.ExpatError, parser) -> str:
    return f"malformed: {expat.ErrorString(e.code)} at byte {parser.ErrorByteIndex}"


def flaw(chunks: Iterable[bytes], encoding: str | None) -> str | None:
    """Why a document can't be read; None if it can. A pass without any work on the elements."""
    parser = expat.ParserCreate(encoding)
    try:
        for data in chunks:
            parser.Parse(data, False)
        parser.Parse(b"", True)
    except expat.ExpatError as e:
        return _reason(e, parser)
    return None


def rejected(reason: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{f.name: None for f in ELEMENT} | {"kind": "reject", "reason": reason}], schema=ELEMENT)


def _scanned(scanner: Scanner, chunks: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    for data in chunks:
        scanner.feed(data, False)
        if len(scanner.rows.flat) >= BATCH:
            yield scanner.taken()
    scanner.feed(b"", True)
    yield scanner.taken()


def scanned(pieces: Callable[[], Iterable[bytes]], size: int, encoding: str | None, strict: bool = False, **choice) -> Iterator[pa.RecordBatch]:
    """The elements of a document in batches of about BATCH, or its reject. pieces gives its bytes from the start, and may be called twice:
    up to WHOLE bytes the elements are held until all is read; for a larger document a first pass without elements tells whether it can be read."""
    if size <= WHOLE:
        scanner = Scanner(encoding, **choice)
        try:
            batches, wrong = list(_scanned(scanner, pieces())), None
        except expat.ExpatError as e:
            batches, wrong = [], _reason(e, scanner.parser)
    else:
        wrong = flaw(pieces(), encoding)
        batches = () if wrong else _scanned(Scanner(encoding, **choice), pieces())
    if wrong and strict:
        raise ValueError(wrong)
    yield from [rejected(wrong)] if wrong else batches


def named(name: str | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of a document's elements with its collection_id."""
    return pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows, pa.string()), *batch.columns], names=["collection_id", *ELEMENT.names])


def _pieces(data: memoryview) -> Iterator[bytes]:
    return (data[at : at + CHUNK] for at in range(0, len(data), CHUNK))


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """collection_id (the file's path) and xml (its text): one row for each collection file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("collection_id"), F.regexp_replace("value", "^\ufeff", "").alias("xml"))


#: Bytes of a batch of texts that goes to a Python worker, and the setting for it.
TEXT_BATCH = 8 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches sent to Python workers, which JVM and worker hold each, unless the session has its own setting."""
    if spark.conf.get(_BATCH_BYTES) == "67108864b":
        spark.conf.set(_BATCH_BYTES, str(TEXT_BATCH))


def parse_collections(
    texts: DataFrame, xml: str = "xml", by: str = "collection_id", strict: bool = False, kinds: tuple[str, ...] = KINDS, attrs: tuple[str, ...] | None = None, children: bool = True,
) -> DataFrame:
    """The elements of XML texts: collection_id and the columns of ELEMENTS.

    kind is track (attrs, children: all elements in it in order; seq: its place among the tracks), node (path: names from below the root;
    parent; playlist: it is one; closed: its tag closes itself), entry (a track of a playlist: parent is the playlist, seq the place in it) or
    reject (reason: no document, or malformed and where); a rejected text has no other rows. strict raises instead. ord numbers a
    document's elements. A playlist's entries are all self-closing tracks with a key in it, those in nodes in it too.

    All of a text is read; rows are made of the kinds asked for only, and carry the attributes attrs (None: all) and, if wanted, children.
    """
    small_batches(texts.sparkSession)
    own = texts.select(F.col(by).cast("string").alias("collection_id"), F.col(xml).alias("xml"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("collection_id").to_pylist(), batch.column("xml"), strict=True):
                data = memoryview(text.as_buffer()) if text.is_valid else b""
                if not text.is_valid and strict:
                    raise ValueError(f"no document in collection {name}")
                try:
                    made = scanned(lambda data=data: _pieces(data), len(data), "UTF-8", strict, kinds=kinds, attrs=attrs, children=children) if text.is_valid else [rejected("no document")]
                    yield from (named(name, x) for x in made)
                except ValueError as e:
                    raise ValueError(f"{e} in collection {name}") from e

    return own.mapInArrow(run, f"collection_id string, {ELEMENTS}").withColumn("collection_id", F.col("collection_id").cast(texts.schema[by].dataType))


def rejects(elements: DataFrame) -> DataFrame:
    """collection_id and reason of the documents that can't be read."""
    return elements.where("kind = 'reject'").select("collection_id", "reason")


def tracks(elements: DataFrame) -> DataFrame:
    """One row for each TRACK of the collections, doc_pos being its place there, with all attributes, its beat grid and its cues as maps."""
    named = [F.col("attrs")[x].alias(k) for k, x in TRACK_FIELDS.items()]
    of = lambda tag: F.transform(F.filter("children", lambda c: c["tag"] == tag), lambda c: c["attrs"])
    return elements.where("kind = 'track'").select("collection_id", F.col("seq").alias("doc_pos"), *named, of("TEMPO").alias("tempos"), of("POSITION_MARK").alias("position_marks"), "attrs")


def nodes(elements: DataFrame) -> DataFrame:
    """One row for each NODE: node_ord (in document order), parent_ord, depth, path (names, without the root's), type, key_type, count, entries, playlist, closed."""
    kept = [F.col("attrs")[x].alias(k) for k, x in {"name": "Name", "type": "Type", "key_type": "KeyType", "count": "Count", "entries": "Entries"}.items()]
    return elements.where("kind = 'node'").select("collection_id", F.col("ord").alias("node_ord"), F.col("parent").alias("parent_ord"), F.size("path").alias("depth"), "path", *kept, "playlist", "closed")


def playlists(elements: DataFrame) -> DataFrame:
    """Playlists in document order (playlist_ord), with path, key_type and closed: its tag closes itself, so it has no entries."""
    return nodes(elements).where("playlist").select("collection_id", F.col("node_ord").alias("playlist_ord"), "path", "key_type", "closed")


def entries(elements: DataFrame) -> DataFrame:
    """collection_id, playlist_ord, pos, track_id"""
    return elements.where("kind = 'entry'").select("collection_id", F.col("parent").alias("playlist_ord"), F.col("seq").alias("pos"), F.col("attrs")["Key"].alias("track_id"))


def document_text(doc: Column) -> Column:
    """The XML text of a collection document."""
    return F.regexp_replace(F.to_xml(doc, {"rowTag": "DJ_PLAYLISTS"}), r"\n$", "")


class _Element:
    """Where an element stands in its document: its start tag, its content, and its attributes in order."""

    def __init__(self, name: str, attributes: list[str], data: bytes, at: int):
        self.name, self.attributes = name, dict(zip(attributes[::2], attributes[1::2], strict=True))
        self.at, self.inner = at, _START_TAG.match(data, at).end()
        self.empty = data[at : self.inner].endswith(b"/>")
        self.end = self.inner  # of its content

    def grown(self, data: bytes, attributes: dict[str, str], more: str = "") -> bytes:
        """The element as text without its end tag, with attributes set, and more after its content; an empty one has an end tag if it has more."""
        tag = _tag(self.name, self.attributes | attributes)
        if self.empty:
            return f"<{tag}>{more}</{self.name}>".encode() if more else f"<{tag}/>".encode()
        return f"<{tag}>".encode() + data[self.inner : self.end] + more.encode()


def _tag(name: str, attributes: dict[str, str | None]) -> str:
    quoted = lambda v: escape(v, {'"': "&quot;", "\n": "&#10;", "\r": "&#13;", "\t": "&#9;"})
    return " ".join([name, *(f'{k}="{quoted(v)}"' for k, v in attributes.items() if v is not None)])


def _found(data: bytes) -> tuple[_Element | None, _Element | None, list[_Element]]:
    """The collection, the root node and the collection's tracks."""
    parser, path, named, tracks_ = expat.ParserCreate("UTF-8"), [], {}, []
    parser.ordered_attributes = True

    def start(name: str, attributes: list[str]) -> None:
        above = {x for x, _ in path}
        own = None
        if "TRACK" not in above and (name == "COLLECTION" or (name == "TRACK" and "COLLECTION" in above) or (name == "NODE" and "PLAYLISTS" in above and "NODE" not in above)):
            own = _Element(name, attributes, data, parser.CurrentByteIndex)
            tracks_.append(own) if name == "TRACK" else named.setdefault(name, own)
        path.append((name, own))

    def end(name: str) -> None:
        own = path.pop()[1]
        if own and not own.empty:
            own.end = parser.CurrentByteIndex

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.Parse(data, True)
    return named.get("COLLECTION"), named.get("NODE"), tracks_


def _raised(counter: str | None, more: int) -> str:
    """A stored counter plus more; text that is no number counts as 0."""
    text = (counter or "").strip()
    return str((int(text) if re.fullmatch(r"\+?[0-9]+", text, re.ASCII) else 0) + more)


def rewritten(xml: str, folder: str, lists: list[dict], made: list[dict]) -> str:
    """The document with a folder of playlists (name, keys) after all nodes below its root, and new tracks (doc_pos of the source, attributes)
    after all others, and with the counters of both raised."""
    data = xml.encode()
    collection, root, own = _found(data)
    if root is None or (made and collection is None):
        raise ValueError("the document has no root node or no collection")
    inner = "".join(f"<{_tag('NODE', {'Name': x['name'], 'Type': '1', 'KeyType': '0', 'Entries': str(len(x['keys']))})}>" + "".join(f"<{_tag('TRACK', {'Key': k})}/>" for k in x["keys"]) + "</NODE>" for x in lists)
    changed = [(root, root.grown(data, {"Count": _raised(root.attributes.get("Count"), 1)}, f"<{_tag('NODE', {'Name': folder, 'Type': '0', 'Count': str(len(lists))})}>{inner}</NODE>"))]
    if made:
        parts = [(own[m["doc_pos"]], {k: v for k, v in m["attributes"].items() if v is not None}) for m in made]
        texts = [t.grown(data, new).decode() + ("" if t.empty else "</TRACK>") for t, new in parts]
        changed.append((collection, collection.grown(data, {"Entries": _raised(collection.attributes.get("Entries"), len(made))}, "".join(texts))))
    out, at = [], 0
    for element, text in sorted(changed, key=lambda x: x[0].at):
        out += [data[at : element.at], text]
        at = element.end
    return b"".join([*out, data[at:]]).decode()


def _exported(rows: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """keys, xml from rows keys, xml, lists, made."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).select(["xml", "lists", "made"]).to_pylist()
                text = rewritten(row["xml"], folder, row["lists"], row["made"])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in keys), pa.array([text], pa.string())], names=[*keys, "xml"])

    return rows.mapInArrow(run, rows.select(*keys, "xml").schema)


def export_sorted(collections: DataFrame, sorted_entries: DataFrame, names: DataFrame, folder: str) -> DataFrame:
    """collection_id, xml: each document with a folder of its sorted playlists, for the collections that have any.

    sorted_entries: what harmonic_sort returns; names: playlist_ord and name of the copies. A collection's document is one row, as its file is one.
    """
    lists = sorted_entries.groupBy("collection_id", "playlist_ord").agg(F.sort_array(F.collect_list(F.struct("new_pos", "track_id")))["track_id"].alias("keys"))
    lists = names.select("collection_id", "playlist_ord", "name").join(lists, ["collection_id", "playlist_ord"], "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    per = lists.groupBy("collection_id").agg(F.sort_array(F.collect_list(F.struct("playlist_ord", "name", "keys"))).alias("lists"))
    none = F.array().cast("array<struct<doc_pos:bigint>>").alias("made")
    rows = collections.join(per.hint("shuffle_hash"), "collection_id").select(
        "collection_id", "xml", F.transform("lists", lambda x: F.struct(x["name"].alias("name"), x["keys"].alias("keys"))).alias("lists"), none,
    )
    return _exported(rows, folder, ["collection_id"])


def export_converted(collections: DataFrame, made: DataFrame, names: DataFrame, folder: str) -> DataFrame:
    """collection_id, playlist_ord, xml: for each converted playlist its collection's document with the new tracks (doc_pos is their source's)
    and a folder with the playlist, named as in names (collection_id, playlist_ord, name)."""
    unit = ["collection_id", "playlist_ord"]
    attributes = F.struct(*[F.col(k).cast("string").alias(x) for x, k in RECOMPUTED.items()])
    per = made.groupBy(*unit).agg(F.sort_array(F.collect_list(F.struct("pos", "doc_pos", attributes.alias("attributes")))).alias("made"))
    per = per.join(names.select(*unit, "name").distinct(), unit)
    rows = collections.join(per.hint("shuffle_hash"), "collection_id").select(
        *unit, "xml", F.array(F.struct("name", F.transform("made", lambda m: m["attributes"]["TrackID"]).alias("keys"))).alias("lists"),
        F.transform("made", lambda m: F.struct(m["doc_pos"].alias("doc_pos"), m["attributes"].alias("attributes"))).alias("made"),
    )
    return _exported(rows, folder, unit)
