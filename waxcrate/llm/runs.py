"""Maximal periodic runs of words in whole texts, found by block convolution.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least max(12, 2q) words that no
neighbouring word extends keeping period q. Where it stands, at least q consecutive words equal the ones q after them. So an aligned
block of B words, B the largest power of two with 2B - 1 <= q, lies among them and comes again q words later: q is one of the 2B
distances from 2B - 1 on (for B = 2: from 1 on, as a run of period 6 or less has at least 6 such words).

For every such scale, each aligned block is held against the window of words that follow it. With a text's words as numbers, the sum of
squared differences at distance q is sum(x^2) + sum(y^2) - 2 sum(x y), whose last part is a convolution: a number-theoretic transform
gives it exactly, modulo as many primes as the largest possible sum needs, so zero means that the block comes again. The zero distances are
the seeds; each is extended word by word to the whole stretch of equal words. Blocks that hold a word which their window lacks at those
distances have no zero and aren't transformed; seeds inside a run already found whose period divides their distance extend to that run,
and are dropped. Of stretches with one start and end the smallest period counts.

Every text is its own row: no shuffle. A text's memory is in proportion to its words, and transforms are made in bounded chunks.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LEAST = 12
#: Primes with 2^23 and more dividing p - 1, all with primitive root 3; the third is needed for texts of over a million words only.
PRIMES, ROOT = (998244353, 469762049, 167772161), 3
#: Numbers that a chunk of transforms holds; words of texts that are searched together.
CHUNK, STEP_WORDS = 1 << 19, 1 << 17
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text or "")


@lru_cache(maxsize=128)
def _powers(size: int, prime: int, inverse: bool) -> np.ndarray:
    """The first size / 2 powers of a root of unity."""
    w = pow(ROOT, (prime - 1) // size, prime)
    w = pow(w, -1, prime) if inverse else w
    out = np.ones(max(1, size // 2), np.uint64)
    n = 1
    while n < size // 2:
        out[n : 2 * n] = out[:n] * np.uint64(pow(w, n, prime)) % np.uint64(prime)
        n *= 2
    return out


def ntt(x: np.ndarray, prime: int) -> np.ndarray:
    """The transforms of the rows of x, in bit-reversed order."""
    p, rows, size = np.uint64(prime), len(x), x.shape[1]
    half = size // 2
    while half:
        v = x.reshape(rows, -1, 2, half)
        a, b = v[:, :, 0], v[:, :, 1]
        x = np.stack([(a + b) % p, (a + (p - b)) * _powers(2 * half, prime, False) % p], axis=2)
        half //= 2
    return x.reshape(rows, size)


def inverse_ntt(x: np.ndarray, prime: int) -> np.ndarray:
    """The rows whose transforms, in bit-reversed order, are those of x."""
    p, rows, size = np.uint64(prime), len(x), x.shape[1]
    half = 1
    while half < size:
        v = x.reshape(rows, -1, 2, half)
        a, b = v[:, :, 0], v[:, :, 1] * _powers(2 * half, prime, True) % p
        x = np.stack([(a + b) % p, (a + (p - b)) % p], axis=2)
        half *= 2
    return x.reshape(rows, size) * np.uint64(pow(size, -1, prime)) % p


def zero_distances(w: np.ndarray, starts: np.ndarray, length: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks w[s : s + length] against the words after them: the (s, d) with d in [first, first + count) where the block comes again at s + d.

    w: numbers from 1 on, and 0 where nothing is equal.
    """
    size = 1 << (count + 2 * length - 3).bit_length()
    largest = int(w.max()) ** 2 * length
    primes, product = [], 1
    for prime in PRIMES:
        if product <= largest:
            primes.append(prime)
            product *= prime
    if product <= largest:
        raise ValueError("a text has too many words for exact sums")
    found = []
    per = max(1, CHUNK // size)
    width = count + length - 1
    for a in range(0, len(starts), per):
        own = starts[a : a + per, None]
        zero = np.ones((len(own), count), bool)
        for prime in primes:
            p = np.uint64(prime)
            x = w[own + np.arange(length)] % p
            y = w[own + first + np.arange(width)] % p
            flipped, window = np.zeros((2, len(own), size), np.uint64)
            flipped[:, :length], window[:, :width] = x[:, ::-1], y
            cross = inverse_ntt(ntt(flipped, prime) * ntt(window, prime) % p, prime)[:, length - 1 : length - 1 + count]
            squares = np.concatenate([np.zeros((len(own), 1), np.uint64), np.cumsum(y * y % p, axis=1)], axis=1)
            both = (x * x % p).sum(axis=1, keepdims=True) + squares[:, length:] - squares[:, : count]
            zero &= both % p == cross * np.uint64(2) % p
        row, d = np.nonzero(zero)
        found.append((own[row, 0], d + first))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _comes_again(keys: np.ndarray, groups: np.ndarray, span: int, at: np.ndarray, first: int, count: int) -> np.ndarray:
    """Whether the word at each place of at stands first to first + count - 1 places later too. keys: sorted group * span + place."""
    low = groups[at] * span + at + first
    i = np.searchsorted(keys, low)
    return (i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] < low + count)


def _matched(w: np.ndarray, at: int, q: int, low: int, high: int) -> tuple[int, int]:
    """The stretch [a, b) around at within [low, high) of places whose word equals the one q later. at itself is such a place."""
    a, b, step = at, at + 1, 32
    while b < high - q:
        n = min(step, high - q - b)
        same = w[b : b + n] == w[b + q : b + q + n]
        if not same.all():
            b += int(same.argmin())
            break
        b, step = b + n, 2 * step
    step = 32
    while a > low:
        n = min(step, a - low)
        same = (w[a - n : a] == w[a - n + q : a + q])[::-1]
        if not same.all():
            a -= int(same.argmin())
            break
        a, step = a - n, 2 * step
    return a, b


def runs_of(codes: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of several texts by start and period; a text is its words' numbers, from 1 on."""
    sizes = np.array([len(c) for c in codes], np.int64)
    ends = np.cumsum(sizes)
    begins, total = ends - sizes, int(sizes.sum())
    found: list[dict[tuple[int, int], int]] = [{} for _ in codes]
    if not total:
        return [[] for _ in codes]
    longest = int(sizes.max())
    text = np.repeat(np.arange(len(codes)), sizes)
    w = np.concatenate([*codes, np.zeros(4 * longest + 16, np.int64)]).astype(np.uint64)
    span = total + 5 * longest + 32
    groups = np.concatenate([begins[text] * 2 + w[:total].astype(np.int64), []]).astype(np.int64)
    keys = np.sort(groups * span + np.arange(total))
    length = 2
    while 2 * (2 * length - 1 if length > 2 else 1) <= longest:
        first, count = (2 * length - 1, 2 * length) if length > 2 else (1, 6)
        starts = np.arange(0, total - length + 1, length)
        starts = starts[(sizes[text[starts]] >= max(LEAST, 2 * first)) & (starts + length <= ends[text[starts]])]
        for i in dict.fromkeys([0, length - 1, length // 2, *range(length)]):
            if not len(starts):
                break
            starts = starts[_comes_again(keys, groups, span, starts + i, first, count)]
        for k in np.unique(text[starts]):
            low, high = int(begins[k]), int(ends[k])
            own = starts[text[starts] == k]
            window = np.concatenate([w[low:high], np.zeros(2 * length + count + first, np.uint64)])
            _extend(w, *zero_distances(window, own - low, length, first, count), low, high, length, found[k])
        length *= 2
    out = []
    for own in found:
        out.append(sorted((a, b - a, q) for (a, b), q in own.items()))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def _extend(w: np.ndarray, at: np.ndarray, q: np.ndarray, low: int, high: int, length: int, found: dict[tuple[int, int], int]) -> None:
    """Extends the seeds (at, q) of a text to whole stretches, and keeps those long enough by start and end with their smallest period."""
    keep = np.ones(len(at), bool)
    for (a, b), period in found.items():
        keep &= ~((q % period == 0) & (at >= a) & (at + q + length <= b))
    at, q = at[keep], q[keep]
    order = np.lexsort((at, q))
    at, q = at[order], q[order]
    i = 0
    while i < len(at):
        d = int(q[i])
        a, b = _matched(w, low + int(at[i]), d, low, high)
        a, b = a - low, b - low
        if b + d - a >= max(LEAST, 2 * d):
            found[a, b + d] = min(d, found.get((a, b + d), d))
        i += 1
        last = int(np.searchsorted(q, d, "right"))
        i = i + int(np.searchsorted(at[i:last], b)) if i < last else i


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words with a periodic end where crc32 of the id as text is divisible by ten. A null id has none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def numbered(words: list[str]) -> np.ndarray:
    """Each word as the number of its first place among different words, from 1 on."""
    of: dict[str, int] = {}
    return np.fromiter((of.setdefault(x, len(of) + 1) for x in words), np.int64, len(words))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words outside all runs and in some run's first period only."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not n]


FIELDS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """docs' ids with n_words, all runs of the whole text by start and period, and the text collapsed: its kept words joined by one blank.

    plant: give some texts a periodic end first (planted). Null and empty texts have no words, no runs and an empty collapsed text; each
    row is its own, so repeated rows give equal results, and an empty table an empty one. Other columns of docs aren't looked at.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(own.dtypes)["doc_id"]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                first, held, n = at, [], 0
                while at < len(texts) and (n < STEP_WORDS or at == first):
                    words = words_of(texts[at])
                    held.append(planted(words, ids[at]) if plant else words)
                    n, at = n + len(words), at + 1
                runs = runs_of([numbered(x) for x in held])
                lists = pa.array([[{"start": a, "length": b, "period": q} for a, b, q in own] for own in runs], run_type)
                kept = pa.array([" ".join(collapsed(x, own)) for x, own in zip(held, runs, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, at - first), pa.array([len(x) for x in held], pa.int64()), lists, kept], names=["doc_id", "n_words", "runs", "collapsed"])

    return own.mapInArrow(run, f"doc_id {kind}, {FIELDS}")


def run_digests(found: DataFrame) -> DataFrame:
    """What periodic_runs found, as numbers and digests: n_runs, the longest run (ties: first start, then period), and two SHA-256."""
    best = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], y["length"] - x["length"]).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]).cast("int"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    top = found.withColumn("top", F.get(best, F.lit(0)))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.floor(F.col("top.length") * 1000 / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
