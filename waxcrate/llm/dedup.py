"""Near-duplicate classes: BagMinHash signatures, banding, exact verification of the multiset overlap, connected components.

Documents with the same words are one node (a digest of the words), so exact copies are never paired. Nodes that share a band meet
at the band's smallest node only; verified links give components. What those links may have missed is a link between nodes of
different components that share a band. Where a band has few nodes they are paired. A large component is dealt to blocks of bounded
bytes instead, and meets all nodes that share a band with it block by block; so do the nodes of small components in a crowded band.
A task takes two blocks; there signatures that agree in too few registers and texts of too different length go first, then what is
in different components is compared exactly, until it is joined. So links inside a component are not listed, and every two
components that share a band have been compared in full. Rows of bands, and the registers that must agree, follow from the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bagminhash
from .common import discard, small_batches, steps, written
from .shingles import mixed, shingle_sets, similarity

THRESHOLD = 0.8
#: Nodes from which a component is large; nodes, and bytes of shingles, that make a block.
LARGE, BLOCK, BLOCK_BYTES = 24, 4096, 16 << 20
#: Rows from which one key of a join counts as hot, if it has a thousandth of all rows too: so at most a thousand keys are.
HOT = 2000
STEP = 2 << 20


def signed(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows doc_id, key (64-bit hash of the text), node (digest of the words; null without words), size (shingles), marks, bands."""
    small_batches(docs.sparkSession)
    rows = bagminhash.band_rows(threshold)
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in steps(texts, STEP):
                sets, nodes = shingle_sets(texts[a:b])
                times = bagminhash.signatures(sets)
                some = np.array([n is not None for n in nodes])
                keys = list(bagminhash.bands(times, rows)) if len(times) else []
                own = [m.tobytes() for m in bagminhash.marks(times)]
                part = batch.slice(a, b - a)
                columns = [part.column("doc_id"), part.column("key"), pa.array(nodes, pa.binary()), pa.array([int(c.sum()) for _, c in sets], pa.int64()), pa.array([m if s else None for m, s in zip(own, some, strict=True)], pa.binary()), pa.array([k if s else None for k, s in zip(keys, some, strict=True)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "node", "size", "marks", "bands"])

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(sign, f"doc_id {kind}, key long, node binary, size long, marks binary, bands array<long>")


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame:
    """key, n of counts (key, n) that hold at least HOT rows and a thousandth of all: no more than a thousand, so they can be broadcast."""
    return counts.where(F.col("n") >= max(HOT, -(-total // 1000))).select(key, "n")


def joined(rows: DataFrame, table: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """The inner join of rows with table on key. Rows of hot keys stay where they are: their few rows of table are broadcast."""
    few = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(table.join(few, key, "left_semi")), key).unionByName(rows.join(few, key, "left_anti").join(table, key))


def agreeing(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The pairs a, b whose signatures agree in at least so many registers."""
    own = nodes.select("node", "marks")
    both = pairs.join(own.toDF("b", "marks_b"), "b").join(own.toDF("a", "marks_a"), "a").select("a", "b", "marks_a", "marks_b")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("marks_a", "marks_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return both.mapInArrow(agree, "a binary, b binary")


def _with_texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, side: str, doc_id: str, text: str) -> DataFrame:
    """wanted with the text of the nodes in column side. Repeated rows of docs may repeat it."""
    at = nodes.select(F.col("node").alias(side), F.col("first.doc_id").alias("_doc"), F.col("first.key").alias("_key"))
    texts = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_own"), F.col(text).alias("text"))
    found = wanted.join(at, side).join(texts, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_own")))
    return found.drop("_doc", "_key", "_id", "_own")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pairs a, b whose weighted similarity is at least the threshold, with it. A hot a is dealt to parts of HOT rows, each with its text."""
    fetched = lambda wanted, side: _with_texts(wanted, nodes, docs, side, doc_id, text)
    hot = F.broadcast(hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), "a", pairs.count()).withColumnRenamed("n", "parts").withColumn("parts", F.ceil(F.col("parts") / HOT)))
    parts = F.coalesce(F.col("parts"), F.lit(1)).cast("int")
    members = fetched(pairs, "b").withColumnRenamed("text", "text_b").join(hot, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int")).drop("parts")
    centres = fetched(pairs.select("a").distinct(), "a").withColumnRenamed("text", "text_a").join(hot, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    both = members.join(centres, ["a", "part"]).select("a", "b", "text_a", "text_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes | None, tuple] = (None, ())
        for batch in batches:
            names = batch.column("a").to_pylist()
            firsts, seconds = batch.column("text_a"), batch.column("text_b").to_pylist()
            found = np.zeros(len(names))
            for p, q in steps(seconds, STEP):
                sets = shingle_sets(seconds[p:q])[0]
                for i in range(p, q):
                    if held[0] != names[i]:
                        held = (names[i], shingle_sets([firsts[i].as_py()])[0][0])
                    found[i] = similarity(held[1], sets[i - p])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], names=["a", "b", "similarity"])

    scored = both.mapInArrow(verify, "a binary, b binary, similarity double").where(F.col("similarity") >= threshold)
    return scored.dropDuplicates(["a", "b"])


def elements(shingle_set: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A multiset of shingles as a sorted set: the k-th time a shingle occurs is an element of its own."""
    values, counts = shingle_set
    if not len(values) or counts.max() == 1:
        return values
    again = np.repeat(values, counts)
    time = np.arange(len(again)) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        return np.sort(np.where(time == 0, again, mixed(again + time.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets as elements gives them."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


#: Candidates of a node up to which each is compared on its own; more are scored at once, with all nodes of the other block.
FEW = 8


def joining_links(left: list[np.ndarray], right: list[np.ndarray], classes: list, marks: np.ndarray, least: int, threshold: float) -> list[tuple[int, int]]:
    """Of all links between left and right as many as join their classes: places in left and right; classes and marks are left's, then right's."""
    n, out = len(left), []
    code = np.unique([str(c) for c in classes], return_inverse=True)[1] if len(classes) else np.zeros(0, np.int64)
    root = np.arange(len(classes))  # of each code
    sizes = np.array([len(x) for x in left], np.int64)
    flat = np.concatenate(left) if left else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(n), sizes)[order]
    for j, own in enumerate(right):
        apart = root[code[:n]] != root[code[n + j]]
        apart &= np.minimum(sizes, len(own)) >= threshold * np.maximum(sizes, len(own)) - 1e-9
        some = np.flatnonzero(apart)
        some = some[(marks[some] == marks[n + j]).sum(axis=1) >= least]
        if len(some) > FEW:
            lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            times = hi - lo
            hits = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
            shared = np.bincount(owner[hits], minlength=n)[some]
            some = some[shared >= threshold * (sizes[some] + len(own) - shared)]
        for i in some.tolist():
            a, b = root[code[i]], root[code[n + j]]
            if a != b and overlap(left[i], own) >= threshold:
                root[root == a] = b
                out.append((i, j))
    return out


def _compare(threshold: float):
    """Of a group of rows node, class, marks, elements, first and second (the blocks that the row is part of): links a, b."""
    least = bagminhash.least_agreeing(threshold)

    def compare(group: pa.Table) -> pa.Table:
        names, classes = group.column("node").to_pylist(), group.column("class").to_pylist()
        data = [np.frombuffer(x, np.uint64) for x in group.column("elements").to_pylist()]
        marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint8).reshape(len(names), -1)
        left, right = (np.flatnonzero(np.array(group.column(c))).tolist() for c in ("first", "second"))
        found = joining_links([data[i] for i in left], [data[i] for i in right], [classes[i] for i in [*left, *right]], marks[[*left, *right]], least, threshold)
        return pa.table({"a": pa.array([names[left[i]] for i, _ in found], pa.binary()), "b": pa.array([names[right[j]] for _, j in found], pa.binary())})

    return compare


def element_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """node, marks, elements: the signature's bytes and the sorted shingle multiset, as bytes, of each wanted node."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in steps(texts, STEP):
                own = [elements(s).tobytes() for s in shingle_sets(texts[a:b])[0]]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(own, pa.binary())], names=["node", "elements"])

    sets = _with_texts(wanted, nodes, docs, "node", doc_id, text).select("node", "text").mapInArrow(take, "node binary, elements binary")
    return written(sets.dropDuplicates(["node"]).join(nodes.select("node", "marks"), "node"), "elements")


def _blocks() -> Column:
    """How many blocks rows with a size take."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).cast("int")


def crowded_links(owned: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Links a, b that join the classes of owned (band, node, class, size) in each band, found block by block."""
    sizes = owned.groupBy("band").agg(_blocks().alias("blocks"))
    dealt = owned.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    rows = dealt.select("band", "node", "class", lo.alias("lo"), hi.alias("hi"), (F.col("block") == lo).alias("first"), (F.col("block") == hi).alias("second"))
    sets = element_sets(owned.select("node").distinct(), nodes, docs, doc_id, text)
    return rows.join(sets, "node").groupBy("band", "lo", "hi").applyInArrow(_compare(threshold), "a binary, b binary")


def large_links(owned: DataFrame, classes: DataFrame, large: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Links a, b between large components and other nodes that share a band with them.

    owned: band, node, class, size of the bands that hold several components; classes: node, class, size; large: class.
    Of two large components the one with the smaller name is dealt to blocks.
    """
    hubs = owned.join(large, "class").select("band", F.col("class").alias("hub")).distinct()
    partners = owned.join(large.select("class", F.lit(True).alias("big")), "class", "left").join(hubs, "band").where((F.col("class") != F.col("hub")) & (F.col("big").isNull() | (F.col("class") > F.col("hub"))))
    partners = written(partners.select("hub", "node", "class", "size").distinct(), "partners")
    chunks = partners.groupBy("hub").agg(_blocks().alias("chunks"))
    blocks = classes.join(large, "class").groupBy(F.col("class").alias("hub")).agg(_blocks().alias("blocks"))
    chunks = written(chunks.join(blocks, "hub"), "chunks")
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda own: (F.lit(own).alias("first"), F.lit(not own).alias("second"))
    left = classes.withColumn("hub", F.col("class")).join(chunks, "hub").select("hub", "node", "class", dealt("blocks").alias("block"), every("chunks").alias("chunk"), *side(True))
    right = partners.join(chunks, "hub").select("hub", "node", "class", every("blocks").alias("block"), dealt("chunks").alias("chunk"), *side(False))
    rows = left.unionByName(right)
    sets = element_sets(rows.select("node").distinct(), nodes, docs, doc_id, text)
    return rows.join(sets, "node").groupBy("hub", "block", "chunk").applyInArrow(_compare(threshold), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, class of all nodes in links a, b: class is the smallest node of the connected component.

    Each round links every node's neighbours to its smallest neighbour, alternately the larger and the smaller ones, until only
    stars are left; a round with pre-aggregated minima doubles the reach, and its links are a table in the shared folder. A round
    that changes nothing has the same number and checksum of links.
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    links, before = written(links, "links"), None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        after = written(smaller, "links")
        sums = [F.count("*").alias("n"), *[F.sum(F.xxhash64("u", "v", F.lit(k)).cast("decimal(20,0)")).alias(f"h{k}") for k in range(2)]]
        now = after.agg(*sums).first()
        discard(links)
        if now == before:
            return after.select(F.col("u").alias("node"), F.col("v").alias("class"))
        links, before = after, now


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, key (hash of its text), class_id, class_key, kept.

    A class has the id of its document with the smallest id (nulls last, ties by the text's hash), which alone is kept. Rows with
    that same id and text are all marked kept: they are one document. Documents without words, or null texts, are classes of
    their own and kept. A text with one to four words is one shingle. Other columns of docs are not looked at, whatever their
    names. An empty table gives an empty result. Tables between the steps are deleted, but for the two that the result reads.
    """
    least = bagminhash.least_agreeing(threshold)
    signs = written(signed(docs, threshold, doc_id, text), "signatures")
    placed = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    nodes = written(signs.where("node is not null").groupBy("node").agg(F.min(placed).alias("first"), F.first("size").alias("size"), F.first("marks").alias("marks"), F.first("bands").alias("bands")), "nodes")
    met = nodes.select("node", F.explode("bands").alias("band"))
    total = nodes.count() * (bagminhash.REGISTERS // bagminhash.band_rows(threshold))
    shared = written(met.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1"), "bands")
    hot = hot_keys(shared, "band", total)
    pairs = joined(met, shared.select("band", "a"), hot, "band").where("node != a").select("a", F.col("node").alias("b")).distinct()
    pairs = written(agreeing(pairs, nodes, least), "pairs")
    links = written(verified(pairs, nodes, docs, threshold, doc_id, text).select("a", "b"), "near")
    found = components(links)

    # Nodes that share a band but no class yet: only bands that still hold several classes.
    label = F.coalesce(F.col("class"), F.col("node"))
    crowded = joined(nodes.select("node", "size", F.explode("bands").alias("band")), shared.select("band"), hot, "band")
    owned = written(crowded.join(found, "node", "left").select("band", "node", "size", label.alias("class")), "crowded")
    several = written(owned.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("band"), "several")
    owned, old = written(joined(owned, several, hot, "band"), "owned"), owned
    large = written(found.groupBy("class").agg((F.count("*") + 1).alias("n")).where(F.col("n") >= LARGE).select("class"), "large")
    spent = [old, several, large, owned]
    parts = [links]
    if not large.isEmpty():
        named = nodes.select("node", "size").join(found, "node", "left").select("node", "size", label.alias("class"))
        parts.append(written(large_links(owned, named, large, nodes, docs, threshold, doc_id, text), "near"))
        owned = written(owned.join(large, "class", "left_anti"), "owned")
        spent.append(owned)
    many = written(owned.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") >= LARGE).select("band"), "many")
    spent.append(many)
    if not many.isEmpty():
        parts.append(written(crowded_links(owned.join(many, "band"), nodes, docs, threshold, doc_id, text), "near"))
        owned = owned.join(many, "band", "left_anti")
    apart = owned.select("band", F.col("node").alias("a"), F.col("class").alias("ca"))
    across = apart.join(owned.select("band", F.col("node").alias("b"), F.col("class").alias("cb")), "band").where("ca < cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    across = across.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = written(agreeing(across, nodes, least), "pairs")
    parts.append(written(verified(more, nodes, docs, threshold, doc_id, text).select("a", "b"), "near"))
    found = components(reduce(DataFrame.unionByName, parts))

    classes = nodes.select("node", "first").join(found, "node", "left").withColumn("class", label)
    heads = classes.groupBy("class").agg(F.min("first").alias("head"))
    of = written(classes.select("node", "class").join(heads, "class").select("node", "head"), "classes")
    discard(nodes, shared, pairs, more, *parts, *spent)
    out = signs.select("doc_id", "key", "node").join(of, "node", "left")
    same = F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.key") == F.col("key"))
    alone = F.col("node").isNull()
    return out.select("doc_id", "key", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), F.when(alone, F.col("key")).otherwise(F.col("head.key")).alias("class_key"), (alone | same).alias("kept"))
