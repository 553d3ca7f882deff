"""Benchmark decontamination: SimHash fingerprints of item-sized windows, a multi-index over their blocks, exact verification.

An item of n words is looked for in windows of n words. Fingerprints are weighted SimHashes of the words, 60 bits in 5 blocks of 12.
Two within the radius agree, up to a fifth of it, in some block, so an index with all near values of each item's blocks finds every
item within the radius; only items of the window's size are looked up. What is found is verified by the exact weighted Jaccard
similarity of the shingles.

Which windows are fingerprinted: a window and an item with v and m shingles that are at least t similar share t / (1 + t) * (v + m)
of them or more. So a text's positions that hold a shingle of the item are gathered, and all windows, and only those, that hold that
many of them go on: no window of similarity t or more is missed. (Fingerprinting every window of every item's size by rolling counters,
prefix sums of the packed lanes and one subtraction a window, takes about 900 CPU seconds a GB of text for each size in DataFrame
functions; README has the figures.) The radius follows from the threshold too: such a window may differ
in a share d = (1 - t) / (1 + t) of its words, so in each bit with probability acos(1 - d) / pi; it is the mean of that and three and
a half deviations, 19 bits for 0.8. DataFrame functions only.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed, let, shingles_of, word_array, written

THRESHOLD, WIDTH = 0.8, 5
BLOCKS, BLOCK_BITS, LANES = 5, 12, 3
BITS = BLOCKS * BLOCK_BITS
#: Rows of the items' shingle table up to which it is broadcast: 32 bytes each, so 32 MB. A larger one is joined by shuffle, in so
#: many parts a shingle, so that a passage that most texts share isn't one task.
BROADCAST_ROWS, SALTS = 1_000_000, 16


def radius(threshold: float) -> int:
    p = math.acos(2 * threshold / (1 + threshold)) / math.pi
    return min(BITS, math.ceil(BITS * p + 3.5 * math.sqrt(BITS * p * (1 - p))))


def simhash(hashes: Column) -> Column:
    """Bit b is set if more than half of the hashes have it. Three 20-bit counters share a number, so up to a million words."""
    lane = BITS // LANES
    ones = sum(1 << (lane * k) for k in range(LANES))

    def counts(x: Column, j: int) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + F.shiftrightunsigned(v, j).bitwiseAND(F.lit(ones)))

    def bits(x: Column) -> Column:
        def majority(sums: Column) -> Column:
            set_ = [F.when(F.shiftrightunsigned(sums[j], lane * k).bitwiseAND(F.lit((1 << lane) - 1)) * 2 > F.size(x), F.lit(1 << (j + lane * k))).otherwise(F.lit(0).cast("long")) for j in range(lane) for k in range(LANES)]
            return reduce(lambda a, b: a.bitwiseOR(b), set_)

        return let(F.array(*[counts(x, j) for j in range(lane)]), majority)

    return let(hashes, bits)


def block(fingerprint: Column, b: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def near_masks(within: int) -> list[int]:
    """What a block may differ by: up to within // BLOCKS bits."""
    return [sum(1 << i for i in c) for n in range(min(within // BLOCKS, BLOCK_BITS) + 1) for c in combinations(range(BLOCK_BITS), n)]


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of hashes as multisets."""

    def of(x: Column, y: Column) -> Column:
        plain = (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_distinct(y)) == F.size(y))
        count = lambda z, v: F.size(F.filter(z, lambda u: u == v))
        both = F.aggregate(F.array_distinct(y), F.lit(0), lambda n, v: n + F.least(count(x, v), count(y, v)))
        shared = F.when(plain, F.size(F.array_intersect(x, y))).otherwise(both)
        return let(shared, lambda s: s / (F.size(x) + F.size(y) - s))

    return let(a, lambda x: let(b, lambda y: of(x, y)))


def candidate_starts(positions: Column, shingles: Column, needed: Column, last: Column) -> Column:
    """All starts from 0 to last of windows of so many shingles that hold at least needed of the sorted positions."""

    def of(p: Column) -> Column:
        def through(i: Column) -> Column:
            low, high = F.greatest(F.lit(0), F.get(p, i + needed - 1) - shingles + 1), F.least(F.get(p, i), last)
            return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size(p) - needed), through)))

    return F.when(F.size(positions) >= needed, let(positions, of)).otherwise(F.array().cast("array<int>"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows doc_id, key (hash of the text), item_id, similarity, start (word of the best window, the first of equals), once each.

    Items and texts with fewer than five words match nothing, nor do nulls; an empty table gives an empty result. A text shorter than
    the item is one window. Of items with the same text each is reported. Repeated rows of docs count once; documents with one id
    but different texts are told apart by key. Other columns of either table are not looked at, whatever their names.
    """
    within = radius(threshold)
    own = items.select(F.col(item_id).alias("item_id"), hashed(word_array(F.col(item_text))).alias("h")).where(F.size("h") >= WIDTH)
    own = own.select("item_id", F.size("h").alias("size"), simhash(F.col("h")).alias("item_print"), shingles_of(F.col("h")).alias("item_shingles"))
    own = written(own.withColumn("item", F.monotonically_increasing_id()), "items")
    places = written(own.select("item", "size", F.explode(F.array_distinct("item_shingles")).alias("shingle")), "item-shingles")
    small = places.count() <= BROADCAST_ROWS

    bodies = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("key"), word_array(F.col(text)).alias("words"))
    runs = bodies.select("doc_id", "key", F.size("words").alias("n"), shingles_of(hashed(F.col("words"))).alias("s")).select("doc_id", "key", "n", F.posexplode("s").alias("pos", "shingle"))
    if small:
        hits = runs.join(F.broadcast(places), "shingle")
    else:
        parts = places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = runs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key", "pos"), F.lit(SALTS)).cast("int")).join(parts, ["shingle", "salt"])
    together = hits.groupBy("doc_id", "key", "n", "item", "size").agg(F.sort_array(F.collect_set("pos")).alias("at"))  # no more than the text has words
    length, whole = F.least("n", "size"), F.col("size") - (WIDTH - 1)
    needed = F.ceil(threshold / (1 + threshold) * (length - (WIDTH - 1) + whole) - 1e-9).cast("int")
    starts = candidate_starts(F.col("at"), length - (WIDTH - 1), F.greatest(F.lit(1), needed), F.col("n") - length)
    windows = together.select("doc_id", "key", "size", starts.alias("starts")).where(F.size("starts") > 0)
    # to drop repeats a window is one number: of numbers array_distinct keeps a hash set, of structs it compares all pairs
    coded = F.transform("starts", lambda x: F.shiftleft(x.cast("long"), 31).bitwiseOR(F.col("size").cast("long")))
    by_doc = windows.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list(coded))).alias("codes"))
    parted = lambda w: F.struct(F.shiftright(w, 31).cast("int").alias("start"), w.bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("size"))
    by_doc = by_doc.select("doc_id", "key", F.transform("codes", parted).alias("windows"))
    by_doc = written(by_doc, "windows")

    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("own"), F.col(text).alias("text"))
    full = by_doc.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("own")))
    # a text's words are hashed once; its windows are cut row by row, so no row holds the words of all of them
    each = full.select("doc_id", "key", "windows", hashed(word_array(F.col("text"))).alias("h")).select("doc_id", "key", F.explode("windows").alias("w"), "h")
    each = each.select("doc_id", "key", "w.start", "w.size", F.slice("h", F.col("w.start") + 1, F.col("w.size")).alias("h"))
    printed = each.withColumn("print", simhash(F.col("h")))

    parts = lambda f: F.array(*[F.struct(F.lit(b).alias("b"), block(F.col(f), b).alias("v")) for b in range(BLOCKS)])
    near = F.explode(F.array(*[F.lit(m).cast("long") for m in near_masks(within)]))
    index = own.select("item", "size", "item_print", F.explode(parts("item_print")).alias("p")).withColumn("mask", near).select("item", "size", "item_print", F.col("p.b").alias("b"), F.col("p.v").bitwiseXOR(F.col("mask")).alias("v"))
    index = written(index, "item-index")
    found = printed.select("*", F.explode(parts("print")).alias("p")).select("doc_id", "key", "start", "size", "h", "print", "p.b", "p.v").join(index, ["size", "b", "v"])
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    earlier = reduce(lambda a, b: a | b, [(F.col("b") > b) & (F.bit_count(block(apart, b)) <= within // BLOCKS) for b in range(BLOCKS - 1)])
    found = found.where((F.bit_count(apart) <= within) & ~earlier)  # once for each window and item: at the first block that finds it
    scored = found.select("doc_id", "key", "start", "item", shingles_of(F.col("h")).alias("s")).join(own.select("item", "item_id", "item_shingles"), "item")
    scored = scored.withColumn("similarity", weighted_jaccard(F.col("s"), F.col("item_shingles"))).where(F.col("similarity") >= threshold)
    best = scored.groupBy("doc_id", "key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "key", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start"))
