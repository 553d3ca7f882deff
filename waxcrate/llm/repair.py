"""Conversation structure repair: the cheapest edits that make roles alternate, and of the cheapest the ASCII-least audit.

A conversation is rows by turn (nulls first; rows of one turn by role, then text; repeated rows stand together). Edits: Keep costs 0, Rerole
to user or assistant 3, Delete 4, Insert an empty user or assistant row 3; rows that are blank or repeat an earlier role and text have
to go, and truncated ones cost 3 unless deleted. The roles left must be an optional s, then ua any number of times, or nothing.

The edits are paths through nodes (row, state), the state being what was written last: nothing (S), the first s (P), u (U) or a (A). Every
node has at most one arc for each edit. Costs to the end are min-plus products of one 4 x 4 matrix a row, from the last row back, taken by
doubling. Arcs on cheapest paths are kept; then nodes are ranked by the least audit of 1, 2, 4 ... edits that leads on from them: the
rank at twice the length is that of the pair (own rank, rank of the node that far on), whose pointer is followed too. The ranks of the
targets select each node's arc, and the pointers, from the longest down, list the nodes of the path.

At scale: rows are range-partitioned by conversation and turn, and cut into blocks of at most BLOCK_ROWS rows and about BLOCK_BYTES of text. Most
conversations are one block, and many blocks go through numpy at once. A conversation of several blocks, which may hold any share of
all rows, is solved through the blocks' matrices: one stream of them from the last to the first gives every block the costs at its end, one
stream the other way the state at its start, and both hold one block at a time. Its SHA-256 is by nature one stream over its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
#: Rows that numpy takes at a time (blocks aren't cut).
STEP_ROWS = 1 << 14
#: Bytes of a role that bounds of range partitions take into account, and of a text.
BOUND_CHARS = 64
_FAR = np.int64(1) << 60
_NEXT = np.array([2, 2, 3, 2])  # the state after a user or assistant row that fits
_NAMES = {2: b"user", 3: b"assistant"}
#: Where keeping a row with initial s, u, a or another leads from each state; -1 where it can't stand.
_KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
_INITIALS = {b"s": 0, b"u": 1, b"a": 2}
_AT_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
#: A row's code: initial (0-3) + 4 if it has to go, + 8 if it is truncated. The end of a conversation is a row of its own.
GOES, CUT, END = 4, 8, 16


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, n of conversations damaged by a hash of id and turn; n: how often the row stands there (0: dropped)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), part(role).alias("role"), part(text).alias("text"), (F.crc32(F.concat_ws(":", part(conv), part(turn)).cast("binary")) % 20).alias("fault"))
    fault = F.col("fault")
    return own.select(
        "conv_id", F.when(fault != 0, F.col("turn")).alias("turn"), F.when(fault == 0, "").when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault <= 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _ended(text: Column) -> Column:
    return F.rtrim(text, F.lit("".join(map(chr, (*range(9, 14), 32)))))


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (of equal rows), again (an earlier turn has the role and text), blank, truncated; equal rows are one."""
    own = rows.withColumn("key", F.sha2(F.concat_ws("\x00", F.col("role"), F.col("text")).cast("binary"), 256))
    once = own.groupBy("conv_id", "turn", "role", "text", "key").agg(F.sum("n").alias("n"))
    # min of a struct: a null turn comes first, as it does in a conversation
    met = own.where("n > 0").groupBy("conv_id", "key").agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    met = met.select(F.col("conv_id").alias("own_id"), F.col("key").alias("own_key"), F.col("first.turn").alias("first_turn"), F.lit(True).alias("met"))
    out = once.join(met, F.col("conv_id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key")), "left")
    again = F.coalesce(F.col("met"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    ended = _ended(F.col("text"))
    return out.select("conv_id", "turn", "role", "text", "n", again.alias("again"), (ended == "").alias("blank"), (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("truncated"))


# Cost matrices and paths, in numpy for many blocks at once.


def _closed(to: np.ndarray) -> np.ndarray:
    """Costs to go on from the states before a row, given those of its own edits: with up to two rows put in first."""
    one = np.minimum(to, to[:, _NEXT] + INSERT)
    return np.minimum(one, one[:, _NEXT] + INSERT)


def row_arcs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[row, state, edit] for Delete, Insert, Keep, Rerole (ASCII order): costs, far where there is no such edit, and states after."""
    n = len(codes)
    cost, to = np.full((n, 4, 4), _FAR), np.zeros((n, 4, 4), np.int64)
    end, more = codes == END, np.where(codes & CUT, TRUNCATED, 0)[:, None]
    stays = ~end & ((codes & GOES) == 0)
    kept = _KEPT[np.where(end, 3, codes & 3)]
    cost[:, :, 0] = np.where(end[:, None], _FAR, DELETE)
    to[:, :, 0] = np.arange(4)
    cost[:, :, 1], to[:, :, 1] = INSERT, _NEXT
    cost[:, :, 2] = np.where((kept >= 0) & stays[:, None], KEEP + more, _FAR)
    cost[end, 0, 2], cost[end, 3, 2] = 0, 0  # a conversation may end here
    to[:, :, 2] = np.where(end[:, None], np.arange(4), np.maximum(kept, 0))
    cost[:, :, 3] = np.where(stays[:, None], REROLE + more, _FAR)
    to[:, :, 3] = _NEXT
    return cost, to


def row_matrices(codes: np.ndarray) -> np.ndarray:
    """[row, state before, state after]: the least cost of passing each row, rows put in before it included."""
    cost, to = row_arcs(codes)
    out = np.full((len(codes), 4, 4), _FAR)
    for edit in (0, 2, 3):
        np.minimum.at(out, (np.arange(len(codes))[:, None], np.arange(4), to[:, :, edit]), cost[:, :, edit])
    return _closed(out)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus products of pairs of matrices."""
    return np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(axis=2), _FAR)


def suffixes(matrices: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Products from each row to the end of its block, by doubling; left: how many rows of the block follow each."""
    out, d = matrices.copy(), 1
    while len(left) and d <= left.max():
        at = np.flatnonzero(left >= d)
        out[at] = _times(out[at], out[at + d])
        d *= 2
    return out


class Paths:
    """The least cheapest paths through blocks, one after the other; ends: [block, state] costs at each block's end."""

    def __init__(self, blocks: list[np.ndarray], ends: np.ndarray):
        sizes = np.array([len(b) for b in blocks], np.int64)
        codes, total = np.concatenate([*blocks, np.zeros(0, np.int64)]).astype(np.int64), int(sizes.sum())
        own = np.repeat(np.arange(len(blocks)), sizes)
        self.last = np.cumsum(sizes + 1) - 1  # layers of nodes: one before each row, and one at the block's end
        self.first = self.last - sizes
        layer = np.arange(total) + own
        left = (np.cumsum(sizes)[own] - 1) - np.arange(total)
        go = (suffixes(row_matrices(codes), left) + ends[own][:, None, :]).min(axis=2)
        costs = np.zeros((total + len(blocks), 4), np.int64)
        costs[self.last], costs[layer] = ends, go
        cost, to = row_arcs(codes)
        after = np.repeat(layer[:, None] + 1, 4, axis=1)
        target = np.stack([np.where(np.arange(4) == 1, layer[:, None], after) * 4 + to[:, s] for s in range(4)], axis=1)
        best = cost + costs.reshape(-1)[target] == go[:, :, None]  # arcs on cheapest paths
        self._rank(layer, target, best, codes)
        self.layer_row = np.full(total + len(blocks), -1)
        self.layer_row[layer] = np.arange(total)
        self.costs = costs

    def _rank(self, layer: np.ndarray, target: np.ndarray, best: np.ndarray, codes: np.ndarray) -> None:
        nodes = np.arange(4 * (int(self.last[-1]) + 1 if len(self.last) else 0))
        at = (layer[:, None] * 4 + np.arange(4)).reshape(-1)
        letter = np.where(best, [1, 2, 3, 4], 9)
        letter[codes == END, :, 2] = np.where(best[codes == END, :, 2], 0, 9)  # an end is before all letters, as a shorter audit is
        letter = letter.reshape(-1, 4)
        flat = target.reshape(-1, 4)
        rank, step = np.zeros(len(nodes), np.int64), nodes.copy()
        lead = letter.argmin(axis=1)
        rank[at], step[at] = letter.min(axis=1), flat[np.arange(len(at)), lead]
        jumps = [step]
        while not (jumps[-1][jumps[-1]] == jumps[-1]).all():  # until every pointer has reached its block's end
            pairs = rank * (int(rank.max()) + 1) + rank[jumps[-1]]
            rank = np.unique(pairs, return_inverse=True)[1]
            jumps.append(jumps[-1][jumps[-1]])
        select = np.where(letter < 9, letter * (int(rank.max(initial=0)) + 1) + rank[flat], np.iinfo(np.int64).max).argmin(axis=1)
        step = nodes.copy()
        step[at] = flat[np.arange(len(at)), select]
        self.edit = np.full(len(nodes), -1)
        self.edit[at] = select
        self.jumps = [step]
        while not (self.jumps[-1][self.jumps[-1]] == self.jumps[-1]).all():
            self.jumps.append(self.jumps[-1][self.jumps[-1]])

    def exits(self) -> np.ndarray:
        """[block, state at the start]: the state at the end."""
        return (self.jumps[-1][4 * self.first[:, None] + np.arange(4)] if len(self.first) else np.zeros((0, 4), np.int64)) % 4

    def edits(self, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each block, from its state at the start: edits in order (0-3 for D, I, K, R), the row of each, and the state before it."""
        begin = 4 * self.first + starts
        reached, depth, block = begin, np.zeros(len(begin), np.int64), np.arange(len(begin))
        for k in range(len(self.jumps) - 1, -1, -1):
            on = self.edit[reached] >= 0
            reached, depth, block = reached[on], depth[on], block[on]
            reached, depth, block = np.concatenate([reached, self.jumps[k][reached]]), np.concatenate([depth, depth + (1 << k)]), np.concatenate([block, block])
        on = self.edit[reached] >= 0
        reached, depth, block = reached[on], depth[on], block[on]
        order = np.lexsort((depth, block))
        reached, cuts = reached[order], np.searchsorted(block[order], np.arange(len(begin) + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = reached[a:b]
            yield self.edit[own], self.layer_row[own // 4], own % 4


_LETTERS = np.frombuffer(b"DIKR", np.uint8)


def written_out(paths: Paths, codes: list[np.ndarray], roles: list[list[bytes]], texts: list[list[bytes]], starts: np.ndarray) -> Iterator[tuple[bytes, bytes, int]]:
    """For each block its audit, its repaired lines joined by line breaks, and how many those are."""
    first = np.cumsum([0, *map(len, codes)])
    for i, (edits, rows, states) in enumerate(paths.edits(starts)):
        real = codes[i][rows - first[i]] != END if len(rows) else np.zeros(0, bool)
        real |= edits == 1
        edits, rows, states = edits[real], rows[real] - first[i], states[real]
        lines = []
        for e, r, s in zip(edits.tolist(), rows.tolist(), states.tolist(), strict=True):
            if e == 2:
                lines.append(roles[i][r] + b":" + texts[i][r])
            elif e:
                lines.append(_NAMES[int(_NEXT[s])] + b":" + (texts[i][r] if e == 3 else b""))
        yield _LETTERS[edits].tobytes(), b"\n".join(lines), len(lines)


# Blocks of rows.

_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_BLOCK = pa.schema([
    ("conv_id", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("edge", pa.bool_()), ("codes", pa.binary()), ("roles", pa.list_(pa.binary())), ("texts", pa.list_(pa.binary())), ("matrix", pa.list_(pa.int64())),
    ("first", pa.binary()), ("last", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), *[(c, pa.int64()) for c in _COUNTS],
])


class _Cutter:
    """Takes the sorted rows of a partition and makes its blocks; a block is an edge unless its conversation surely ends with it."""

    def __init__(self, part: int):
        self.part, self.seq, self.out, self.held = part, 0, [], 0
        self.conv, self.begun, self.blocks, self.first = None, False, 0, True
        self.clear()

    def clear(self) -> None:
        self.codes, self.roles, self.texts, self.bytes = [], [], [], 0
        self.heads, self.low, self.high, self.turns = [None, None], None, None, 0
        self.counts = dict.fromkeys(_COUNTS, 0)

    def block(self, edge: bool) -> None:
        codes = np.array(self.codes, np.int64)
        whole = suffixes(row_matrices(codes), np.arange(len(codes))[::-1])[0] if edge and len(codes) else np.where(np.eye(4) > 0, 0, _FAR)
        self.out.append({
            "conv_id": self.conv, "part": self.part, "seq": self.seq, "edge": edge, "codes": bytes(self.codes), "roles": self.roles, "texts": self.texts, "matrix": whole.reshape(-1).tolist() if edge else None,
            "first": self.heads[0], "last": self.heads[1], "low": self.low, "high": self.high, "turns": self.turns, **self.counts,
        })
        self.seq, self.blocks, self.held = self.seq + 1, self.blocks + 1, self.held + self.bytes
        self.clear()

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        """The blocks made so far, if they are so many or hold much text."""
        if len(self.out) >= least or self.held > 2 * BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist(self.out, schema=_BLOCK)
            self.out, self.held = [], 0

    def close(self, last: bool) -> None:
        """Ends the conversation at hand; last: the partition ends too, so it may go on in the next."""
        if self.begun:
            self.block(edge=last or self.first or self.blocks > 0)
            self.first = False
        self.begun, self.blocks = False, 0

    def add(self, row: dict) -> None:
        if not self.begun or row["conv_id"] != self.conv:
            self.close(False)
            self.conv, self.begun = row["conv_id"], True
        if row["turn"] is not None and row["turn"] != self.high:
            self.low, self.high, self.turns = row["turn"] if self.low is None else self.low, row["turn"], self.turns + 1
        kind = _INITIALS.get(row["role"][:1], 3)
        for copy in range(row["n"]):
            fault = "blank" if row["blank"] else "duplicate" if row["again"] or copy else "truncated" if row["truncated"] else None
            if fault:
                self.counts[fault] += 1
            initial = row["initial"]
            self.counts["illegal"] += self.heads[1] is not None and self.heads[1] + initial not in (b"su", b"ua", b"au")
            self.heads = [initial if self.heads[0] is None else self.heads[0], initial]
            goes = fault in ("blank", "duplicate")
            self.codes.append(kind + (GOES if goes else CUT if fault else 0))
            self.roles.append(b"" if goes else row["role"])
            self.texts.append(b"" if goes else row["text"])
            self.bytes += 0 if goes else len(row["role"]) + len(row["text"])
            if len(self.codes) >= BLOCK_ROWS or self.bytes >= BLOCK_BYTES:
                self.block(edge=True)


def blocks_of(rows: DataFrame) -> DataFrame:
    """The blocks of judged rows, in order by part and seq; conv_id as text."""
    bound = [F.substring("role", 1, BOUND_CHARS).alias("role_head"), F.substring("text", 1, BOUND_CHARS).alias("text_head")]
    ordered = rows.withColumn("conv_id", F.col("conv_id").cast("string")).withColumns({"role_head": bound[0], "text_head": bound[1]})
    ordered = ordered.repartitionByRange("conv_id", "turn", "role_head", "text_head").sortWithinPartitions("conv_id", "turn", "role", "text")
    initial = F.substring("role", 1, 1).cast("binary").alias("initial")
    ordered = ordered.select("conv_id", "turn", F.col("role").cast("binary").alias("role"), initial, F.col("text").cast("binary").alias("text"), "n", "again", "blank", "truncated")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(TaskContext.get().partitionId())
        for batch in batches:
            for row in batch.to_pylist():
                cutter.add(row)
                yield from cutter.batches(256)
        cutter.close(True)
        yield from cutter.batches(1)

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return ordered.mapInArrow(cut, f"conv_id string, part long, seq long, edge boolean, codes binary, roles array<binary>, texts array<binary>, matrix array<long>, first binary, last binary, low long, high long, turns long, {counts}")


def _codes(batch: pa.RecordBatch, last: list[bool]) -> list[np.ndarray]:
    """Codes of a batch's blocks, with the end row where a conversation ends."""
    return [np.append(np.frombuffer(c, np.uint8).astype(np.int64), [END] if e else []).astype(np.int64) for c, e in zip(batch.column("codes").to_pylist(), last, strict=True)]


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about STEP_ROWS rows."""
    sizes = [len(c) for c in batch.column("codes").to_pylist()]
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > STEP_ROWS:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


_RESULT = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_OUT = pa.schema([("conv_id", pa.string()), *[(c, pa.int64()) for c in ("gaps", *_COUNTS, "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _whole(blocks: DataFrame) -> DataFrame:
    """The results of conversations that are one block."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _groups(batch):
                codes = _codes(own, [True] * own.num_rows)
                paths = Paths(codes, np.zeros((len(codes), 4), np.int64))
                done = list(written_out(paths, codes, own.column("roles").to_pylist(), own.column("texts").to_pylist(), np.zeros(len(codes), np.int64)))
                facts = own.select(["conv_id", "low", "high", "turns", *_COUNTS]).to_pylist()
                rows = [
                    {"conv_id": f["conv_id"], "gaps": f["high"] - f["low"] + 1 - f["turns"] if f["turns"] else 0, **{c: f[c] for c in _COUNTS}, "cost": cost, "audit": audit.decode(), "repaired_sha256": hashlib.sha256(text).hexdigest()}
                    for f, cost, (audit, text, _) in zip(facts, paths.costs[paths.first, 0].tolist(), done, strict=True)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=_OUT)

    return blocks.mapInArrow(solve, _RESULT)


def _streamed(blocks: DataFrame, names: list[str], schema: str, run, descending: bool = False) -> DataFrame:
    """run over the blocks of each conversation as one stream, in order or from the last one back."""
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in ("conv_id", "part", "seq")]
    return blocks.select(*names).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def _end_costs(edges: DataFrame) -> DataFrame:
    """part, seq, ends (the costs from each state at the block's end), last (its conversation ends there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, costs = None, False, None
        for batch in batches:
            rows = {"part": batch.column("part").to_pylist(), "seq": batch.column("seq").to_pylist(), "ends": [], "last": []}
            for own, matrix in zip(batch.column("conv_id").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
                new = not begun or own != conv
                if new:
                    conv, begun, costs = own, True, _AT_END
                rows["ends"].append(costs.tolist())
                rows["last"].append(new)
                costs = np.minimum((np.array(matrix, np.int64).reshape(4, 4) + costs).min(axis=1), _FAR)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("ends", pa.list_(pa.int64())), ("last", pa.bool_())]))

    return _streamed(edges, ["conv_id", "part", "seq", "matrix"], "part long, seq long, ends array<long>, last boolean", run, True)


def _ends_of(batch: pa.RecordBatch) -> np.ndarray:
    """Costs at the ends of blocks; after an end row there are none."""
    ends = np.array(batch.column("ends").to_pylist(), np.int64).reshape(-1, 4)
    ends[np.array(batch.column("last").to_pylist(), bool)] = 0
    return ends


def _start_states(edges: DataFrame) -> DataFrame:
    """part, seq, start: the state at each block's start."""

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _groups(batch):
                found = Paths(_codes(own, own.column("last").to_pylist()), _ends_of(own)).exits()
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("conv_id", "part", "seq")), pa.array(found.tolist(), pa.list_(pa.int64()))], names=["conv_id", "part", "seq", "exits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, state = None, False, 0
        for batch in batches:
            starts = []
            for own, found in zip(batch.column("conv_id").to_pylist(), batch.column("exits").to_pylist(), strict=True):
                if not begun or own != conv:
                    conv, begun, state = own, True, 0
                starts.append(state)
                state = found[state]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("seq"), pa.array(starts, pa.int64())], names=["part", "seq", "start"])

    names = ["conv_id", "part", "seq", "exits"]
    found = edges.select("conv_id", "part", "seq", "codes", "ends", "last").mapInArrow(exits, "conv_id string, part long, seq long, exits array<long>")
    return _streamed(found, names, "part long, seq long, start long", run)


def _pieces(edges: DataFrame) -> DataFrame:
    """Each block's piece of the audit and of the repaired text, with its facts."""
    kept = ["conv_id", "part", "seq", "start", "ends", "last", "matrix", "first", "last_initial", "low", "high", "turns", *_COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _groups(batch):
                starts = np.array(own.column("start").to_pylist(), np.int64)
                codes = _codes(own, own.column("last").to_pylist())
                done = list(written_out(Paths(codes, _ends_of(own)), codes, own.column("roles").to_pylist(), own.column("texts").to_pylist(), starts))
                made = [pa.array([d[0].decode() for d in done], pa.string()), pa.array([d[1] for d in done], pa.binary()), pa.array([d[2] for d in done], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in kept), *made], names=[*kept, "audit", "piece", "lines"])

    kinds = dict(edges.dtypes)
    return edges.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", audit string, piece binary, lines long")


def _joined(pieces: DataFrame) -> DataFrame:
    """The results of conversations from their pieces, each read as one stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at = None, None

        def row() -> pa.RecordBatch:
            gaps = at["high"] - at["low"] + 1 - at["turns"] if at["turns"] else 0
            out = {"conv_id": conv, "gaps": gaps, **{c: at[c] for c in _COUNTS}, "cost": at["cost"], "audit": "".join(at["audit"]), "repaired_sha256": at["hash"].hexdigest()}
            return pa.RecordBatch.from_pylist([out], schema=_OUT)

        for batch in batches:
            for i in range(batch.num_rows):
                (x,) = batch.slice(i, 1).to_pylist()
                if at is None or x["conv_id"] != conv:
                    if at is not None:
                        yield row()
                    cost = (np.array(x["matrix"], np.int64).reshape(4, 4) + np.array(x["ends"], np.int64)).min(axis=1)[0]
                    conv, at = x["conv_id"], {"hash": hashlib.sha256(), "lines": 0, "audit": [], "cost": int(cost), "initial": None, "low": None, "high": None, "turns": 0} | dict.fromkeys(_COUNTS, 0)
                for c in _COUNTS:
                    at[c] += x[c]
                if at["initial"] is not None and x["first"] is not None:
                    at["illegal"] += at["initial"] + x["first"] not in (b"su", b"ua", b"au")
                at["initial"] = at["initial"] if x["last_initial"] is None else x["last_initial"]
                if x["turns"]:
                    at["turns"] += x["turns"] - (at["high"] == x["low"])
                    at["low"], at["high"] = x["low"] if at["low"] is None else at["low"], x["high"]
                at["audit"].append(x["audit"])
                if x["lines"]:
                    at["hash"].update((b"\n" if at["lines"] else b"") + x["piece"])
                    at["lines"] += x["lines"]
        if at is not None:
            yield row()

    return _streamed(pieces, pieces.columns, _RESULT, run)


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text, n as damaged returns them): conv_id, gaps (turns missing between the least
    and the greatest), blank, duplicate, truncated, illegal (neighbours that aren't su, ua or au), cost, audit, repaired_sha256.

    A null conv_id is a conversation like any other; null turns come first and count in no gap; rows that repeat are duplicates. A role
    without a first letter can't be kept. Texts may have any length. A conversation all of whose rows have n = 0 has zeros, an
    empty audit and the hash of nothing; an empty table gives an empty result. Other columns aren't looked at.
    """
    spark = rows.sparkSession
    small_batches(spark)
    kind = dict(rows.dtypes)["conv_id"]
    blocks = written(blocks_of(judged(rows)), "blocks")
    edges = blocks.where("edge").withColumnRenamed("last", "last_initial")
    ends = written(_end_costs(edges), "block-ends")
    edges = edges.join(ends, ["part", "seq"])
    starts = written(_start_states(edges), "block-starts")
    out = _whole(blocks.where("NOT edge")).unionByName(_joined(_pieces(edges.join(starts, ["part", "seq"]))))
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))
