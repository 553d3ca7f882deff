"""Token ids of whole texts by the tokenizers library, for the token operators.

The public BPE tokenizers cut a text before their merges, always between a letter and a following blank, line break or one of
``,.!?``, and before a blank between two visible characters. So a text has the ids of its pieces between such places, one after
the other: each different piece goes to the library once and is kept in a bounded table that the Python worker reuses. Pieces of
Latin letters go straight to the tokenizer's BPE model; any other piece, to its whole encoding. The text of a special token has
the token's id, as the library gives it by default: such texts hold no blank and are no plain letters, so no cut falls inside one,
which the encoder checks when it loads a vocabulary.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Different pieces kept by a worker. When the table is full it starts again; results don't depend on it.
KEPT_PIECES = 800_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PIECE = re.compile(
    rf" ?[{_LETTERS}]++(?=[ \n,.!?]|\Z)"  # letters only, up to a place where the tokenizers cut
    rf"| ?[,.!?]++(?=[ \n{_LETTERS}]|\Z)"
    rf"|\n(?=[{_LETTERS}])"
    r"|[\s\S]+?(?=(?<=\S) \S|\Z)"  # anything else, up to a blank between visible characters
)
_PLAIN = re.compile(rf" ?[{_LETTERS}]+\Z")


def vocabulary(path: str) -> str:
    """A file name of the public tokenizers' folder, or a path."""
    if os.path.sep in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def byte_letters() -> list[str]:
    """The character that byte-level tokenizers write for each byte: itself if it is printable, else the next from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class _Numbered(dict):
    """Numbers each new key, and lists it in new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = at = len(self)
        self.new.append(key)
        return at


class PieceEncoder:
    """Encodes texts into flat ids; the same ids as tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, keep: int = KEPT_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.keep = self.tokenizer.model, keep
        for token in self.tokenizer.get_added_tokens_decoder().values():
            if len(_PIECE.findall(f"a{token.content}a")) > 1 or _PLAIN.match(token.content) or token.lstrip or token.rstrip or token.single_word or token.normalized:
                raise ValueError(f"the special token {token.content!r} doesn't stay in one piece")
        self.letters = byte_letters()
        self.spelt = {chr(i): "".join(self.letters[b] for b in chr(i).encode()) for i in range(128, 256)}
        ids = self.tokenizer.encode("A b", add_special_tokens=False).ids
        self.lower = ids == self.tokenizer.encode("a b", add_special_tokens=False).ids
        self.blank = ids != self.tokenizer.encode("Ab", add_special_tokens=False).ids and self.tokenizer.decode(ids[1:2]).startswith(" ")
        self.clear()

    def clear(self) -> None:
        self.index = _Numbered()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 15, np.int64)
        self.used = self.count = 0

    def piece_ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece: plain ones in bulk through the model, spelt in its letters; the others by whole encodings."""
        plain = [p for p in pieces if _PLAIN.match(p)]
        spelt = "\n".join(plain)
        spelt = spelt if self.blank else spelt.replace(" ", "")
        spelt = spelt.lower() if self.lower else spelt
        spelt = spelt.replace(" ", self.letters[32])
        if not spelt.isascii():
            spelt = "".join([x if x.isascii() else "".join([y if y < "\x80" or y > "\xff" else self.spelt[y] for y in x]) for x in re.split("(\n)", spelt)])
        tokenize = self.model.tokenize
        done = iter([[t.id for t in tokenize(x)] for x in spelt.split("\n")] if plain else [])
        return [next(done) if _PLAIN.match(p) else self.tokenizer.encode(p, add_special_tokens=False).ids for p in pieces]

    def add(self) -> None:
        """Encodes the pieces that have been numbered since the last call."""
        lists = self.piece_ids(self.index.new)
        flat = np.array([i for ids in lists for i in ids], np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(lists) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.used : self.used + len(flat)] = flat
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        self.ends[self.count + 1 : self.count + 1 + len(lists)] = self.used + np.cumsum(lengths)
        self.used, self.count = self.used + len(flat), self.count + len(lists)
        self.index.new = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and len(texts) + 1 offsets of the texts in them."""
        if self.count > self.keep:
            self.clear()
        code, codes, counts = self.index.__getitem__, [], []
        for text in texts:
            cut = _PIECE.findall(text)
            counts.append(len(cut))
            codes.append(np.fromiter(map(code, cut), np.int64, len(cut)))
        if self.index.new:
            self.add()
        every = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        starts = self.ends[every]
        lengths = self.ends[every + 1] - starts
        after = np.cumsum(lengths)
        flat = self.ids[np.repeat(starts - after + lengths, lengths) + np.arange(int(after[-1]) if len(after) else 0)]
        edges = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])]
        return flat, edges


@lru_cache(maxsize=4)
def encoder(name: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    return PieceEncoder(vocabulary(name))


@lru_cache(maxsize=4)
def byte_widths(name: str) -> np.ndarray:
    """Bytes of text that each id of a byte-level tokenizer stands for: its characters each stand for one byte."""
    t = encoder(name).tokenizer
    widths = np.zeros(t.get_vocab_size(with_added_tokens=True), np.int64)
    for token, i in t.get_vocab(with_added_tokens=False).items():
        widths[i] = len(token)
    for i, token in t.get_added_tokens_decoder().items():
        widths[i] = len(token.content.encode())
    return widths
