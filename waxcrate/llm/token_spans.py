"""Token counts by section: each text is encoded once, as a whole, and its tokens' character spans are joined to the sections'.

A token belongs to the section that holds its anchor byte. The rule names the anchor: "start" (the token's first byte), "end"
(its last) or "middle" (the middle one, so a token that crosses a boundary goes to the larger part, ties to the earlier).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, steps
from .tokens import byte_widths, encoder

RULES = ("start", "middle", "end")


def line_sections(text: str) -> np.ndarray:
    """Character bounds of the lines of a text, each with its line break; they cover the text. An empty text is one empty line."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    return np.array([0, *(e for e in ends if e < len(text)), len(text)], np.int64)


def byte_places(text: str) -> np.ndarray | None:
    """The byte at which each character begins, and the text's bytes last; None if characters are bytes."""
    if text.isascii():
        return None
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def section_tokens(docs: DataFrame, vocab: str = "byte_bpe_50k.json", rule: str = "middle", sections: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows doc_id, section (from 0), start, end (characters), n_tokens.

    sections: a column of arrays of (start, end), in characters; None takes the text's lines. Sections may overlap or leave gaps:
    each counts the tokens anchored in it. Bounds are cut to the text. Null texts count as empty, null sections as none; a line
    section of an empty text has no tokens. Repeated rows give repeated results. vocab: a byte-level tokenizer gives its spans by
    the widths of its ids; any other, by the library's offsets.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([F.col(sections).cast("array<struct<start:long,end:long>>").alias("spans")] if sections else []))
    id_type = kept.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocab)
        widths = byte_widths(vocab) if e.blank else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = batch.column("spans").to_pylist() if sections else None
            ids = batch.column("doc_id")
            for a, b in steps(texts):
                if widths is not None:
                    flat, edges = e.encode(texts[a:b])
                    wide = widths[flat]
                whose, number, starts, ends, counts = [], [], [], [], []
                for i in range(a, b):
                    if widths is not None:
                        to = np.cumsum(wide[edges[i - a] : edges[i - a + 1]])
                        since = to - wide[edges[i - a] : edges[i - a + 1]]
                        place = byte_places(texts[i])
                    else:
                        since, to = np.array(e.tokenizer.encode(texts[i], add_special_tokens=False).offsets, np.int64).reshape(-1, 2).T
                        place = None
                    anchor = since if rule == "start" else to - 1 if rule == "end" else (since + to - 1) // 2
                    if sections:
                        bounds = np.array([(s["start"] or 0, len(texts[i]) if s["end"] is None else s["end"]) for s in spans[i] or [] if s], np.int64).reshape(-1, 2)
                        lo, hi = np.clip(bounds, 0, len(texts[i])).T
                    else:
                        cut = line_sections(texts[i])
                        lo, hi = cut[:-1], cut[1:]
                    at = lambda x: np.searchsorted(anchor, x if place is None else place[x])  # noqa: B023, E731
                    whose.append(np.full(len(lo), i))
                    number.append(np.arange(len(lo)))
                    starts.append(lo)
                    ends.append(hi)
                    counts.append(np.maximum(at(hi) - at(lo), 0))
                columns = [np.concatenate(x).astype(np.int64) for x in (number, starts, ends, counts)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(whose).astype(np.int64))), *map(pa.array, columns)], names=["doc_id", "section", "start", "end", "n_tokens"])

    return kept.mapInArrow(count, f"doc_id {id_type}, section long, start long, end long, n_tokens long")
