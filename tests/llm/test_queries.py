"""Each registered query on a whole small table, against the contract of its result worked out row by row."""

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

pytest.importorskip("waxcrate.llm.queries")
from waxcrate.llm import shingles
from waxcrate.llm.queries import QUERIES
from waxcrate.llm.tokens import vocabulary

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, name, n):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == n
    return rows


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, texts):
    """All pairs compared exactly: a class is a component of the pairs of 0.8 and more."""
    ids = sorted(texts)
    sets, names = shingles.shingle_sets([texts[i] for i in ids])
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if names[i] and names[j] and shingles.similarity(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, doc in enumerate(ids):
        least[find(i)].append(doc)
    expected = {doc: (min(own), doc == min(own)) for own in least.values() for doc in own}
    assert {r["doc_id"]: (r["class_id"], r["kept"]) for r in rows_of(spark, "op1_near_duplicates", len(ids))} == expected
    assert len(least) < len(ids)


def test_op2(spark, texts):
    rows = rows_of(spark, "op2_toxicity", len(texts))
    assert {r["doc_id"] for r in rows if r["held_out"]} == {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_op3(spark, texts):
    t, start, expected = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), 0, []
    for doc in sorted(texts):
        ids = [*t.encode(texts[doc], add_special_tokens=False).ids, 0]
        expected.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(spark, "op3_token_files", len(texts))) == expected


def test_op5(spark, texts):
    t, expected = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), {}
    for doc in texts:
        ids = [*t.encode(texts[doc], add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            expected[doc, piece] = (at, len(ids[at : at + 4096]), crc(ids[at : at + 4096]))
    rows = rows_of(spark, "op5_best_fit_packing", len(expected))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) == -(-sum(n for _, n, _ in expected.values()) // 4096)  # no fewer sequences are possible


def words_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def test_op8(spark, texts):
    """Every window of each item's size that shares a shingle with it."""
    of = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    words = {i: words_of(x) for i, x in texts.items()}
    expected = {}
    for item, text in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect():
        own = of(words_of(text or ""))
        if not own:
            continue
        counts, size = Counter(own), len(own) + 4
        for doc, w in words.items():
            s = of(w)
            hits = [p for p, x in enumerate(s) if x in counts]
            length = min(size, len(w))
            best = (0.0, 0)
            for start in sorted({a for p in hits for a in range(max(0, p - length + 5), min(p, len(w) - length) + 1)}):
                window = Counter(s[start : start + length - 4])
                shared = sum((window & counts).values())
                best = max(best, (shared / (length - 4 + len(own) - shared), -start))
            if best[0] >= 0.8:
                expected[doc, item] = (pytest.approx(best[0]), -best[1])
    rows = QUERIES["op8_decontamination"](spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in rows} == expected and len(rows) == len(expected) > 0


def test_op9(spark, texts):
    for r in rows_of(spark, "op9_quality_rules", len(texts)):
        text = texts[r["doc_id"]]
        words, seen, again = re.findall(r"[^\x20\x09-\x0D]+", text), set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
        failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), failed)
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == expected
        assert not (failed and r["kept"])


def test_op10(spark, texts):
    """A token goes to the line that holds its middle byte."""
    t, expected = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), {}
    for doc, text in texts.items():
        ends = np.cumsum([len(line.encode()) + 1 for line in text.split("\n")])
        at, found = 0, Counter()
        for token in t.encode(text, add_special_tokens=False).tokens:
            found[int(np.searchsorted(ends, at + (len(token) - 1) // 2, "right"))] += 1
            at += len(token)
        for line in range(len(ends)):
            expected[doc, line] = found[line]
    rows = rows_of(spark, "op10_token_counts", len(expected))
    assert {(r["doc_id"], r["section"]): r["n_tokens"] for r in rows} == expected


DOCS = "doc_id long, text string"


def test_a_text_that_repeats_items_thousands_of_times(spark):
    """Windows of one text are many, and each is cut by itself; what is found is the first best window of each item."""
    from waxcrate.llm.decontaminate import contaminated

    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30))), (2, " ".join(f"w{i}" for i in range(3, 29))), (3, " ".join(f"v{i}" for i in range(20)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "start " + " ".join(f"w{i % 30}" for i in range(9000))), (3, "w1 w2 w3 w4")], DOCS)
    found = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in contaminated(docs, items).collect()}
    assert found[1, 1] == (1.0, 1) and found[1, 2] == (1.0, 4) and (3, 1) not in found and not any(i == 3 for _, i in found)


def test_one_row_repeated_through_the_token_files(spark):
    """A null id with a null text, and one document, thousands of times: each row has its place, and the files add up."""
    from waxcrate.llm.token_files import token_file_rows

    rows = [(None, None)] * 3000 + [(7, "the same words")] * 2000 + [(9, "others")]
    out = token_file_rows(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    n = len(Tokenizer.from_file(vocabulary("byte_bpe_50k.json")).encode("the same words", add_special_tokens=False).ids) + 1
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in sorted(out, key=lambda r: r["start"])][:5001] == [*((None, i, 1) for i in range(3000)), *((7, 3000 + i * n, n) for i in range(2000)), (9, 3000 + 2000 * n, out[-1]["n_tokens"])]


def test_very_long_texts_are_scored_but_not_trained_on(spark):
    from waxcrate.llm import toxicity

    docs = spark.createDataFrame([(1, "some words"), (2, "word " * 20_000), (3, None)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3)], "doc_id long, toxic int")
    assert [r["doc_id"] for r in toxicity.training_rows(docs, labels).collect()] == [i for i in (1,) if zlib.crc32(b"1") % 5]
    assert max(len(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()) < toxicity.LONGEST
