"""Language identification by bit-sliced Bloom filters of n-grams.

Every language has a Bloom filter over its n-grams, all of one size and with the same hash functions. The filters are stored sliced: slot j
holds one bit for each language, so the AND of an n-gram's slots is the bitmask of all languages that contain it. A text's n-grams
give each language a popcount c out of N; a filter with false-positive rate f gives c = t + (N - t) f, so (c - N f) / (1 - f) of them
are its own. The language with the most decides.

N-grams are runs of four bytes of the lower-cased text in UTF-8, with ASCII characters other than letters as one blank. A language's
filter holds those that make up at least one in 100,000 (SHARE) of its n-grams, counted over all its documents: so rare foreign words
don't fill it as the corpus grows, and a filter has at most 1 / SHARE entries at any size, which bounds what is gathered and broadcast.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, steps, written

#: Bytes of an n-gram (8 at most, so that it is a number); hash functions; slots for each entry of the largest filter.
WIDTH, HASHES, SLOTS_PER_ENTRY = 4, 4, 16
SHARE = 1e-5
#: Different languages that filters are built for; more are an error.
MOST_LANGUAGES = 512
UNDETERMINED = "und"
#: N-grams that a step holds at a time, and different ones that a training task counts before it hands them on.
STEP_GRAMS, KEPT_GRAMS = 1 << 20, 1 << 20
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_BLANKS = re.compile(b" +")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def is_learned(doc_id: Column) -> Column:
    """True for rows to learn from: crc32 of the id as text mod 4 is not 2. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 != 2


def gram_bytes(text: str) -> bytes:
    """The bytes that n-grams are cut from."""
    return _BLANKS.sub(b" ", b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b" ")


def gram_numbers(data: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Every run of width bytes as a number."""
    n = max(0, len(data) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out << np.uint64(8)) | data[i : i + n]
    return out


def slots(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """The slots of each n-gram among 2 ** bits, one array for each hash function."""
    with np.errstate(over="ignore"):
        x = grams ^ (grams >> np.uint64(31))
        return [((x * f) ^ ((x * f) >> np.uint64(29))) * _FACTORS[(i + 1) % HASHES] >> np.uint64(64 - bits) for i, f in enumerate(_FACTORS[:HASHES])]


@dataclass
class Filters:
    """languages in order; masks[word, slot] with one bit for each language; rates: false positives of each; first: the one with most text."""

    languages: list[str]
    masks: np.ndarray
    bits: int
    rates: np.ndarray
    first: int

    def containing(self, grams: np.ndarray) -> np.ndarray:
        """[word, n-gram]: the bitmasks of all languages that contain each n-gram."""
        at = slots(grams, self.bits)
        out = self.masks[:, at[0]]
        for more in at[1:]:
            out &= self.masks[:, more]
        return out

    def popcounts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """[text, language]: n-grams of each text that each language contains; and how many each text has. In steps of STEP_GRAMS."""
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        last = np.maximum(starts, ends - WIDTH + 1)  # n-grams begin in [starts, last)
        data = np.frombuffer(b"".join(texts), np.uint8)
        found = np.zeros((len(texts), len(self.languages)), np.int64)
        for a in range(0, len(data), STEP_GRAMS):
            masks = self.containing(gram_numbers(data[a : a + STEP_GRAMS + WIDTH - 1]))
            low, high = np.clip(starts - a, 0, masks.shape[1]), np.clip(last - a, 0, masks.shape[1])
            for i in range(len(self.languages)):
                total = np.concatenate([[0], np.cumsum((masks[i >> 6] >> np.uint64(i & 63)) & np.uint64(1), dtype=np.int64)])
                found[:, i] += total[high] - total[low]
        return found, last - starts

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and the score of each text: its share of all languages' corrected counts. Ties go to the first in order.

        A text without a letter, or a null one, is undetermined, as is every text where there are no languages; a text none of whose
        n-grams is known gets the language with most text, with score 0.
        """
        lettered = [bool(self.languages) and t is not None and any(map(str.isalpha, t)) for t in texts]
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        own = [i for i, x in enumerate(lettered) if x]
        if own:
            found, n = self.popcounts([gram_bytes(texts[i]) for i in own])
            with np.errstate(divide="ignore", invalid="ignore"):
                true = np.where(self.rates < 1, (found - n[:, None] * self.rates) / (1 - self.rates), 0).clip(0)
            best, total = true.argmax(axis=1), true.sum(axis=1)
            for row, i in enumerate(own):
                known = total[row] > 0
                names[i] = self.languages[best[row] if known else self.first]
                scores[i] = float(true[row, best[row]] / total[row]) if known else 0.0
        return names, scores


def gram_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, gram, n: occurrences of every n-gram of all texts by language. Tasks add up their own before the shuffle."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def rows(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for name, (grams, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], schema=schema)

    def merged(parts: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for name, own in parts.items():
            grams, at = np.unique(np.concatenate([g for g, _ in own]), return_inverse=True)
            total = np.zeros(len(grams), np.int64)
            np.add.at(total, at, np.concatenate([n for _, n in own]))
            out[name] = (grams, total)
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = defaultdict(list), 0
        for batch in batches:
            names, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for a, b in steps(texts):
                by = defaultdict(list)
                for name, t in zip(names[a:b], texts[a:b], strict=True):
                    by[name].append(gram_bytes(t))
                for name, own in by.items():
                    # the first blank of the next text parts two texts; a run of bytes over both is dropped by its two blanks
                    data = np.frombuffer(b"".join(own), np.uint8)
                    for at in range(0, len(data), STEP_GRAMS):
                        grams = gram_numbers(data[at : at + STEP_GRAMS + WIDTH - 1])
                        blank = np.frombuffer(data[at : at + STEP_GRAMS + WIDTH - 1].tobytes(), np.uint8) == 32
                        both = np.concatenate([[0], np.cumsum(blank[1:] & blank[:-1])])
                        grams = grams[both[WIDTH - 1 : len(grams) + WIDTH - 1] == both[: len(grams)]]
                        parts[name].append(np.unique(grams, return_counts=True))
                        held += len(parts[name][-1][0])
            if held > KEPT_GRAMS:
                total = merged(parts)
                held = sum(len(g) for g, _ in total.values())
                if held > KEPT_GRAMS // 2:
                    yield from rows(total)
                    total, held = {}, 0
                parts = defaultdict(list, {k: [v] for k, v in total.items()})
        yield from rows(merged(parts))

    small_batches(docs.sparkSession)
    own = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return own.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, lang: str = "lang", text: str = "text", share: float = SHARE) -> Filters:
    """The filters of all languages of docs, from all its texts. Null texts and languages count nothing; no rows give no languages.

    Only entries of the filters and one row for each language leave the executors: at most 1 / share n-grams a language are set in at
    most HASHES slots each, and the slots, whose number that bounds too, are what the driver gathers.
    """
    counts = written(gram_counts(docs, lang, text), "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    spark = docs.sparkSession
    few = spark.createDataFrame(totals, "lang string, total long")
    held = counts.join(F.broadcast(few), "lang").where(F.col("n") >= F.col("total") * share)
    sizes = held.groupBy("lang").agg(F.count("*").alias("entries"), F.first("total").alias("total")).orderBy("lang").collect()
    languages = [r["lang"] for r in sizes]
    bits = max(10, (SLOTS_PER_ENTRY * max((r["entries"] for r in sizes), default=0) - 1).bit_length())
    number = {name: i for i, name in enumerate(languages)}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            grams = batch.column("gram").to_numpy().astype(np.uint64)
            own = [pa.array(np.tile(at >> 6, HASHES)), pa.array(np.concatenate(slots(grams, bits)).astype(np.int64)), pa.array(np.tile(np.left_shift(np.int64(1), at & 63), HASHES))]
            yield pa.RecordBatch.from_arrays(own, names=["word", "slot", "bit"])

    masks = np.zeros((max(1, (len(languages) + 63) >> 6), 1 << bits), np.uint64)
    if languages:
        sliced = held.select("lang", "gram").mapInArrow(spread, "word long, slot long, bit long").groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()
        masks[sliced["word"].to_numpy(), sliced["slot"].to_numpy()] = sliced["mask"].to_numpy().astype(np.uint64)
    discard(counts)
    filled = [float(((masks[i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).mean()) for i in range(len(languages))]
    first = max(range(len(languages)), key=lambda i: sizes[i]["total"], default=0)
    return Filters(languages, masks, bits, np.array(filled) ** HASHES, first)


def identified(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """docs with lang_pred and score for its whole texts, in place of columns of those names.

    Null texts and texts without a letter are und, with score 0. Every row is its own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    at, shared = names.index(text), spark.sparkContext.broadcast(filters)
    kinds = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, scores = batch.column(at).to_pylist(), [], []
            for a, b in steps([t or "" for t in texts]):
                own = shared.value.decide(texts[a:b])
                found += own[0]
                scores += own[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return kept.mapInArrow(run, f"{kinds}, lang_pred string, score double")
