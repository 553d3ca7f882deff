"""Best-fit packing of token pieces into fixed-length sequences by a grouping genetic algorithm.

A document longer than a sequence is cut into pieces of the sequence's length. Pieces are dealt by hash to shards of bounded size;
two islands evolve each shard's packing. An individual is a list of bins. Crossover injects the other parent's best-filled bins
whole, removes the own bins that hold any of their pieces, and puts the displaced pieces back by best fit, largest first. Mutation
opens the emptiest bins and some others, and fills new ones from their pieces, each as full as any of their subsets makes it. Between
the epochs each island sends its best packing to the other island of its shard (elite migration). Bins that stay under the keep
level are opened again, and their pieces are dealt anew to fewer shards, until one shard holds what is left.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, steps, written
from .tokens import encoder

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_KEYS = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of a shard at most, about; bins filled to this share are kept as they are.
SHARD, KEEP = 3000, 0.995
#: Individuals of an island, generations at most, and generations without a better one after which it stops.
POPULATION, GENERATIONS, PATIENCE = 6, 60, 12


def token_pieces(docs: DataFrame, vocab: str = "word_bpe_49k.json", end_id: int = 1, length: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32: the ids of each whole text and the end id, cut only if longer than length."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocab)
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for a, b in steps(texts):
                flat, edges = e.encode(texts[a:b])
                flat = np.insert(flat, edges[1:], end_id).astype("<u4")
                edges = edges + np.arange(len(edges))
                rows = [(i, p, s, min(length, n - s)) for i, n in enumerate(np.diff(edges).tolist()) for p, s in enumerate(range(0, n, length))]
                crc = [zlib.crc32(flat[(at := edges[i] + s) : at + n]) for i, _, s, n in rows]
                doc, piece, start, size = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc).cast(pa.int64())) if a == 0 else ids.slice(a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], schema=PIECES)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(cut, _KEYS)


class Bins:
    """Bins in making, with the fullest bin that still takes a piece found in the bits of one number."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.rooms = capacity, {}, 0
        self.bins: list[list[int]] = []

    def open(self, items: list[int], room: int) -> None:
        self.bins.append(items)
        self.by_room.setdefault(room, []).append(items)
        self.rooms |= 1 << room

    def best_fit(self, item: int, size: int) -> None:
        if not (fits := self.rooms >> size):
            self.open([item], self.capacity - size)
            return
        room = size + (fits & -fits).bit_length() - 1
        own = self.by_room[room]
        items = own.pop()
        if not own:
            self.rooms ^= 1 << room
        items.append(item)
        self.by_room.setdefault(room - size, []).append(items)
        self.rooms |= 1 << (room - size)


def fill(order: list[int], sizes: list[int], capacity: int, bins: list[list[int]] = ()) -> list[list[int]]:
    """The bins given, and the items of order put by best fit into them or into new ones."""
    out = Bins(capacity)
    for items in bins:
        out.open(list(items), capacity - sum(sizes[i] for i in items))
    for i in order:
        out.best_fit(i, sizes[i])
    return out.bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then the fuller ones, by the mean square of their filling."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def fullest(items: list[int], sizes: list[int], room: int) -> list[int]:
    """The items whose sizes come nearest to room without passing it: sums that are reached as the bits of a number."""
    mask, reached = (1 << (room + 1)) - 1, [1]
    for i in items:
        reached.append((reached[-1] | reached[-1] << sizes[i]) & mask)
    left, out = reached[-1].bit_length() - 1, []
    for k in range(len(items) - 1, -1, -1):
        if not reached[k] >> left & 1:
            out.append(items[k])
            left -= sizes[items[k]]
    return out


def refill(items: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins for items: each begins with the largest item left, and takes the others that fill it best."""
    left, bins = sorted(items, key=lambda i: -sizes[i]), []
    while left:
        chosen = set(fullest(left[1:], sizes, capacity - sizes[left[0]]))
        bins.append([left[0], *chosen])
        left = [i for i in left[1:] if i not in chosen]
    return bins


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """A child of a with the better-filled bins of b, whole; the displaced items go by best fit."""
    level = capacity * (1 - rng.choice((0.0, 0.002, 0.01)))
    injected = [x for x in b if sum(sizes[i] for i in x) >= level and rng.random() < 0.7]
    taken = {i for x in injected for i in x}
    kept = [x for x in a if taken.isdisjoint(x)]
    displaced = sorted((i for x in a if not taken.isdisjoint(x) for i in x if i not in taken), key=lambda i: -sizes[i])
    return fill(displaced, sizes, capacity, [*injected, *kept])


def mutated(bins: list[list[int]], sizes: list[int], capacity: int, rng: random.Random, opened: int = 24) -> list[list[int]]:
    """The emptiest bins and as many others opened, and their items put into as few new ones as refill finds."""
    bins = sorted(bins, key=lambda x: sum(sizes[i] for i in x))
    n = rng.randint(2, opened)
    also = set(rng.sample(range(n, len(bins)), min(n, max(0, len(bins) - n))))
    loose = [i for k, x in enumerate(bins) if k < n or k in also for i in x]
    return [x for k, x in enumerate(bins) if k >= n and k not in also] + refill(loose, sizes, capacity)


def least_bins(sizes: list[int], capacity: int) -> int:
    """No packing has fewer: all sizes together, or the items of which no two share a bin."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]] = (), generations: int = GENERATIONS, patience: int = PATIENCE) -> list[list[int]]:
    """The best packing of an island: until it has the least number of bins, or some generations have found nothing better.

    Elites join the first population, beside best fit with the largest first and with blurred orders.
    """
    rng = random.Random(seed)
    score = lambda x: fitness(x, sizes, capacity)
    least, population = least_bins(sizes, capacity), [(score(x), x) for x in map(list, elites)]
    for blur in (0.0, 0.2, 0.4) if not elites else (0.3,):
        if population and -population[0][0][0] <= least:
            break
        x = fill(sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(1 - blur, 1.0)), sizes, capacity)
        population = sorted([*population, (score(x), x)], key=lambda y: y[0], reverse=True)
    idle = 0
    for _ in range(generations):
        if -population[0][0][0] <= least or idle >= patience:
            break
        (_, a), (_, b) = rng.sample(population, 2) if len(population) > 1 else population * 2
        child = mutated(crossover(a, b, sizes, capacity, rng), sizes, capacity, rng)
        best = population[0][0]
        population = sorted([*population, (score(child), child)], key=lambda y: y[0], reverse=True)[:POPULATION]
        idle = 0 if population[0][0] > best else idle + 1
    return population[0][1]


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values("place", ignore_index=True)


def _numbers(bins: list[list[int]], n: int) -> np.ndarray:
    """The bin of each of n items."""
    out = np.empty(n, np.int32)
    out[[i for items in bins for i in items]] = np.repeat(np.arange(len(bins)), [len(items) for items in bins])
    return out


def _first_epoch(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        bins = evolve(pdf["length"].tolist(), capacity, seed=zlib.crc32(repr(tuple(map(int, key))).encode()))
        pdf["bin"] = _numbers(bins, len(pdf))
        return pdf

    return run


def _second_epoch(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        elites = []
        for _, own in sorted(pdf.groupby("island")):
            own = _ordered(own)
            order = own["bin"].to_numpy().argsort(kind="stable")
            elites.append([x.tolist() for x in np.split(order, np.flatnonzero(np.diff(own["bin"].to_numpy()[order])) + 1)])
        own = own.drop(columns=["island", "bin"])
        sizes = own["length"].tolist()
        bins = max((evolve(sizes, capacity, int(key[0]) * 2 + k, elites) for k in (0, 1)), key=lambda x: fitness(x, sizes, capacity))
        order = np.array([i for items in bins for i in items])
        lengths = own["length"].to_numpy()[order]
        counts = np.array([len(items) for items in bins])
        before = np.cumsum(lengths) - lengths
        first = np.cumsum(counts) - counts
        offset, held = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
        offset[order] = before - np.repeat(before[first], counts)
        held[order] = np.repeat(np.add.reduceat(lengths, first), counts)
        own["bin"], own["offset"], own["held"] = _numbers(bins, len(own)), offset, held
        return own.drop(columns="shard")

    return run


def pack(pieces: DataFrame, capacity: int = 4096, shard: int = SHARD, keep: float = KEEP) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset, in as few sequences as it finds.

    Repeated rows are pieces of their own, and ids may be null. Pieces are dealt by their place in the written table, so no id, however
    frequent, makes a shard large; another layout of the input may give another packing. An empty table gives an empty result; other
    columns are left out. A pass keeps the bins at or over the keep level, or the fuller half if those are fewer, so each leaves half
    of its bins at most; the last one has one shard. Each pass writes its pieces to the shared folder.
    """
    left, parts, k = written(pieces.select(*PIECES.names, F.monotonically_increasing_id().alias("place")), "pieces"), [], 0
    rows = f"{_KEYS}, place long"
    while True:
        shards = max(1, -(-left.count() // shard))
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("place", F.lit(k)), F.lit(shards)))
        apart = dealt.withColumn("island", F.explode(F.array(F.lit(0), F.lit(1))))
        first = apart.groupBy("shard", "island").applyInPandas(_first_epoch(capacity), f"{rows}, shard long, island int, bin int")
        second = first.withColumn("to", F.col("shard")).groupBy("to").applyInPandas(lambda key, pdf: _second_epoch(capacity)(key, pdf.drop(columns="to")).assign(shard=key[0]), f"{rows}, bin int, offset long, held long, shard long")
        packed = written(second, "packed")
        numbered = packed.withColumn("sequence_id", (F.lit(k) * F.lit(1 << 40) + F.col("shard")) * F.lit(1 << 20) + F.col("bin"))
        if shards == 1:
            parts.append(numbered)
            break
        middle = packed.where("offset = 0").agg(F.percentile_approx("held", 0.5)).first()[0]
        full = F.col("held") >= min(keep * capacity, middle)
        parts.append(numbered.where(full))
        left, k = packed.where(~full).select(*left.columns), k + 1
    return reduce(DataFrame.unionByName, parts).select(*PIECES.names, "sequence_id", "offset")
