"""Encoding of whole texts with a byte-level BPE tokenizer file, segment by segment.

The tokenizer cuts a text into words before it merges, and never puts white space into a word that began before it. A text
can therefore be cut in front of every blank or line end that follows something other than white space, and segments can be
encoded on their own or one after another. Most segments recur: a batch of texts is cut as one run of bytes, its different
segments are found by Arrow, and a worker encodes each of them once, many in one call, and keeps what it got. What a batch
needs is then gathered from there, so that nothing in Python runs once for every segment.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: characters that some engine may call white space; no safe boundary comes after one of them
ASCII_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
SPACES = ASCII_SPACES + "\x85\xa0\u1680\u180e" + "".join(map(chr, range(0x2000, 0x200e))) + "\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
SPACE_SET = frozenset(SPACES)
#: segments encoded in one call, segments remembered, characters of the longest one that is
CALL_SEGMENTS = 1 << 15
MEMORY = 300_000
MEMORABLE = 64
#: bytes of text that are cut and encoded at once
BATCH_BYTES = 1 << 23

IS_BREAK = np.isin(np.arange(256), [0x20, 0x0A])
IS_SPACE = np.isin(np.arange(256), list(ASCII_SPACES.encode()))
#: the last bytes of the other white space, as one number
WIDE = {n: np.array([int.from_bytes(c.encode()) for c in SPACES if len(c.encode()) == n]) for n in (2, 3)}


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes in front of every blank and line end after something other than white space."""
    at = np.flatnonzero(IS_BREAK[data[1:]] & ~IS_SPACE[data[:-1]]) + 1
    wide = at[data[at - 1] >= 0x80]
    if len(wide):
        before = lambda i: data[np.maximum(wide - i, 0)].astype(np.int64)
        two = before(2) << 8 | before(1)
        space = np.isin(two, WIDE[2]) | np.isin(before(3) << 16 | two, WIDE[3])
        at = at[~np.isin(at, wide[space], assume_unique=True)]
    return at


def _worker_memory(name: str) -> dict:
    """What the Python worker keeps from task to task."""
    module = sys.modules.setdefault("widesift_worker_memory", types.ModuleType("widesift_worker_memory"))
    return module.__dict__.setdefault(name, {})


class _Store:
    """Ids of segments one after another, found by the segment."""

    def __init__(self):
        self.slots: dict[bytes, int] = {}
        self.n = 0
        self.starts = np.zeros(1 << 16, np.int64)  # one more than there are segments
        self.ids = np.zeros(1 << 18, "<u4")

    def add(self, ids: np.ndarray, stops: np.ndarray) -> None:
        first = self.starts[self.n]
        while self.n + len(stops) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while first + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[first:first + len(ids)] = ids
        self.starts[self.n + 1:self.n + 1 + len(stops)] = first + stops
        self.n += len(stops)


class Encoder:
    """Ids of texts, each segment encoded once while remembered. All encoders of a worker with the same file share what they remember."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab()
        #: bytes of each token; a token is written with one character for each byte
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = added.get(i, len(token))
        self.memory = _worker_memory(path)

    def _encoded(self, items: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
        """Some of the segments, their ids in a row and where each one's ids end."""
        texts = {s: s.decode() for s in items}
        # a segment that begins with white space and ends with something else can follow and be followed by others
        joined = [s for s, t in texts.items() if t[0] in " \n" and t[-1] not in SPACE_SET]
        alone = [] if len(joined) == len(texts) else [s for s, t in texts.items() if t[0] not in " \n" or t[-1] in SPACE_SET]
        for i in range(0, len(alone), CALL_SEGMENTS):
            batch = alone[i:i + CALL_SEGMENTS]
            ids = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([texts[s] for s in batch], add_special_tokens=False)]
            yield batch, np.concatenate(ids), np.cumsum(list(map(len, ids)))
        for i in range(0, len(joined), CALL_SEGMENTS):
            batch = joined[i:i + CALL_SEGMENTS]
            encoding, = self.tokenizer.encode_batch_fast([b"".join(batch).decode()], add_special_tokens=False)
            ids = np.array(encoding.ids, "<u4")
            ends = np.cumsum(self.bytes[ids])
            want = np.cumsum(list(map(len, batch)))
            stops = np.searchsorted(ends, want) + 1
            if not np.array_equal(ends[stops - 1], want):
                raise ValueError("the file holds no byte-level BPE tokenizer without normaliser")
            yield batch, ids, stops

    def _slots(self, store: _Store, segments: list[bytes]) -> np.ndarray:
        """The place of each of different segments in the store; long ones come last there and are not remembered."""
        found = list(map(store.slots.get, segments))
        new = [i for i, slot in enumerate(found) if slot is None]
        short, long = [], []
        for i in new:
            (long if len(segments[i]) > MEMORABLE else short).append(segments[i])
        passing: dict[bytes, int] = {}
        for items, slots in ((short, store.slots), (long, passing)):
            for batch, ids, stops in self._encoded(items):
                slots.update(zip(batch, range(store.n, store.n + len(batch))))
                store.add(ids, stops)
        for i in new:
            found[i] = store.slots.get(segments[i], passing.get(segments[i]))
        store.passing = len(passing)
        return np.array(found, np.int64)

    def _cut(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The segments of all texts, and how many come before the end of each text, beginning with 0."""
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        starts = np.zeros(len(data) + 1, bool)
        starts[boundaries(data)] = True
        starts[offsets] = True
        at = np.flatnonzero(starts[:-1])
        ends = np.append(at, len(data)).astype(np.int32)
        segments = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        return segments, np.searchsorted(at, offsets)

    def __call__(self, column: pa.Array, lengths_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids before the end of each text, beginning with 0) for a column without nulls."""
        segments, by_text = self._cut(column)
        store = self.memory.get("store")
        if store is None or len(store.slots) > MEMORY:
            store = self.memory["store"] = _Store()
        different = segments.dictionary_encode()
        slots = self._slots(store, different.dictionary.to_pylist())[different.indices.to_numpy()]
        starts = store.starts[slots]
        lengths = store.starts[slots + 1] - starts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = np.zeros(0, "<u4") if lengths_only else store.ids[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
        store.n -= store.passing
        return ids, ends[by_text]


def by_bytes(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """Stretches of a text column, null as empty, of about `most` bytes however long single texts are."""
    column = column.fill_null("")
    lengths = np.asarray(pc.binary_length(column))
    first, size = 0, 0
    for i, n in enumerate(lengths.tolist(), 1):
        size += n
        if size >= most or i == len(column):
            yield column.slice(first, i - first)
            first, size = i, 0
