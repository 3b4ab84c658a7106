"""Packing by minimum bin slack.

A document's ids are cut into full sequences and a remainder. A task gathers remainders up to a bounded number of ids. It opens
a sequence with the longest one and fills the rest of the window by a subset-sum over the remaining lengths: one bit for each
reachable sum, a lengths' copies added in powers of two, and the counts of the best sum traced back. The same choice is
repeated while its pieces last. What no choice fills is filled with the front of a cut remainder. Nothing is shuffled.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from widesift.llm.tokens import Encoder, by_bytes

#: ids of remainders a task gathers before it packs them
POOL_IDS = 4_000_000
#: rows of output at once
OUT_ROWS = 2048
SCHEMA = "start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def best_fill(counts: list[int], room: int) -> dict[int, int]:
    """How many of each length add up to the largest sum within `room`; counts[n] is the number of pieces of length n.

    Longer lengths are tried first, and no further ones once the room is filled.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in range(min(room, len(counts) - 1), 0, -1):
        if not counts[length]:
            continue
        most, chunk = min(counts[length], room // length), 1
        while most > 0:
            chunk = min(chunk, most)
            steps.append((length, chunk, reach))
            reach |= reach << (length * chunk) & mask
            most -= chunk
            chunk *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, chunk, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + chunk
            at -= length * chunk
    return used


@dataclass
class Piece:
    key: object
    start: int
    doc_tokens: int
    ids: bytes  # little-endian, four to an id

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.key, self.start, self.doc_tokens, self.ids[:4 * n]),
                Piece(self.key, self.start + n, self.doc_tokens, self.ids[4 * n:]))


class Packer:
    """Takes the documents of a task and gives placed pieces: (piece, sequence number, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.sequence = capacity, 0
        self.pool: list[list[Piece]] = [[] for _ in range(capacity)]
        self.counts = [0] * capacity
        self.held = 0

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        piece = Piece(key, 0, len(ids) // 4, ids)
        while len(piece) >= self.capacity:
            full, piece = piece.cut(self.capacity)
            yield from self._emit([full])
        if len(piece):
            self._hold(piece)
        if self.held >= POOL_IDS:
            yield from self.pack(last=False)

    def _hold(self, piece: Piece) -> None:
        n = len(piece)
        self.pool[n].append(piece)
        self.counts[n] += 1
        self.held += n

    def _take(self, length: int) -> Piece:
        self.counts[length] -= 1
        self.held -= length
        return self.pool[length].pop()

    def _longest(self) -> int:
        return next(n for n in range(self.capacity - 1, 0, -1) if self.counts[n])

    def _emit(self, pieces: list[Piece]) -> Iterator[tuple]:
        offset = 0
        for piece in pieces:
            yield piece, self.sequence, offset
            offset += len(piece)
        self.sequence += 1

    def pack(self, last: bool) -> Iterator[tuple]:
        """Packs the pool; keeps what fills less than a window unless it is the last time."""
        while self.held >= self.capacity:
            longest = self._longest()
            self.counts[longest] -= 1
            used = best_fill(self.counts, self.capacity - longest)
            self.counts[longest] += 1
            used[longest] = used.get(longest, 0) + 1
            slack = self.capacity - sum(n * c for n, c in used.items())
            order = sorted(used.items(), reverse=True)
            for _ in range(1 if slack else min(self.counts[n] // c for n, c in order)):
                pieces = [self._take(n) for n, c in order for _ in range(c)]
                if slack:  # the rest of the pool has only pieces longer than the slack
                    front, back = self._take(next(n for n in range(slack + 1, self.capacity) if self.counts[n])).cut(slack)
                    pieces.append(front)
                    self._hold(back)
                yield from self._emit(pieces)
        if last and self.held:
            yield from self._tail()

    def _tail(self) -> Iterator[tuple]:
        """Less than a window is left: sequences at powers of two, which need no padding."""
        rest = [self._take(self._longest()) for _ in range(sum(self.counts))]
        total = sum(map(len, rest))
        while total:
            room, pieces = 1 << (total.bit_length() - 1), []
            total -= room
            while room:
                piece = rest.pop(0)
                if len(piece) > room:
                    piece, back = piece.cut(room)
                    rest.insert(0, back)
                pieces.append(piece)
                room -= len(piece)
            yield from self._emit(pieces)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """A row for each piece: (key_col, start, length, doc_tokens, sequence_id, offset, ids).

    Every row of `docs` becomes its text's ids (null: none) and `end_id`; each id lies in exactly one piece. `ids` holds the
    piece's ids as little-endian unsigned 32-bit numbers. Sequences are full but for the last ones of a task, whose lengths are
    powers of two, so that no padding is needed. Rows with equal texts or keys are packed each for itself; an empty table gives
    no piece; other columns are ignored, whatever their names, and a text's length bounds no step but its encoding. A sequence id is the partition's number and the sequence's number in it: a lost task makes the same ones again
    as long as its input has the same order, as that of a table read from files does.
    """
    kind = docs.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        end, packer = struct.pack("<I", end_id), Packer(capacity)
        first = TaskContext.get().partitionId() << 36
        key_type = [None]

        def placed() -> Iterator[tuple]:
            for batch in batches:
                key_type[0] = batch.schema.field(0).type
                keys, row = batch.column(0), 0
                for part in by_bytes(batch.column(1)):
                    ids, stops = encode(part)
                    raw, stops = ids.tobytes(), (4 * stops).tolist()
                    for i, j in zip(stops, stops[1:]):
                        yield from packer.add(keys[row].as_py(), raw[i:j] + end)
                        row += 1
            yield from packer.pack(last=True)

        rows: list[tuple] = []
        for row in placed():
            rows.append(row)
            if len(rows) >= OUT_ROWS:
                yield _batch(rows, first, key_type[0])
                rows = []
        if rows:
            yield _batch(rows, first, key_type[0])

    rows = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key_col)


def _batch(rows: list[tuple], first: int, key_type: pa.DataType) -> pa.RecordBatch:
    longs = lambda values: pa.array(values, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([p.key for p, _, _ in rows], key_type), longs([p.start for p, _, _ in rows]), longs([len(p) for p, _, _ in rows]),
         longs([p.doc_tokens for p, _, _ in rows]), longs([first + s for _, s, _ in rows]), longs([o for _, _, o in rows]),
         pa.array([p.ids for p, _, _ in rows], pa.binary())], ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
