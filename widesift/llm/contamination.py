"""Benchmark decontamination by a suffix automaton of the test items.

The automaton accepts every run of words of every item. A document's words are streamed through it, which gives the
longest run ending at each word that some item contains; where that run reaches a window, the state names the items.
Items are cut into shards of bounded size. A worker builds the automata of the shards one after another and merges the
hits of a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: words are runs of digits, letters and bytes beyond ASCII, after A-Z are lower-cased
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: of item text in one automaton, which takes some 200 times that in a worker
SHARD_BYTES = 1 << 20
#: of rows that a worker holds while it goes through several shards
HELD_BYTES = 1 << 25
SCHEMA = "n_words bigint, hits array<struct<start:bigint,end:bigint>>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TO_WORDS).split()


class Automaton:
    """Generalised suffix automaton over words.

    step[s]: word -> state; link[s]: state of the longest suffix in another class; length[s]: longest run of the state.
    window[s]: item indices that contain the last `window` words of any run of s that long; short[s]: (words, item) of the
    items shorter than a window that end a run of s.
    """

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int):
        self.step, self.link, self.length = [{}], [-1], [0]
        ends: list[tuple[int, int]] = []
        self.names: list[str | None] = []
        short: dict[int, list[tuple[int, int]]] = {}
        for name, words in items:
            if not words:
                continue
            item = len(self.names)
            self.names.append(None if name is None else str(name))
            last = 0
            for n, word in enumerate(words, 1):
                last = self._extend(last, word)
                if n >= window:
                    ends.append((last, item))
            if len(words) < window:
                short.setdefault(last, []).append((len(words), item))
        self._name(ends, short, window)
        self.window_words = window
        self.least = min([window, *(n for found in short.values() for n, _ in found)])

    def _new(self, length: int, step: dict, link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of the runs of q that are no longer than length[p] + 1; q itself if there are no others."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.step[last]:
            return self._split(last, word, self.step[last][word])
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, word, self.step[p][word])
        return state

    def _name(self, ends, short, window: int) -> None:
        states = sorted(range(len(self.link)), key=self.length.__getitem__)
        at: list[int] = [-1] * len(states)  # the state among a state and its suffixes that holds runs of a window's length
        self.short: list[tuple] = [()] * len(states)
        for s in states[1:]:
            up = self.link[s]
            at[s] = at[up] if at[up] >= 0 else s if self.length[s] >= window else -1
            self.short[s] = (*short.get(s, ()), *self.short[up])
        found: dict[int, set[int]] = {}
        for s, item in ends:
            found.setdefault(at[s], set()).add(item)
        self.window = [found.get(x, ()) for x in at]

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Disjoint [start, end) of the words inside occurring windows, and the items these belong to."""
        step, link, length, window, short = self.step, self.link, self.length, self.window, self.short
        least, full = self.least, self.window_words
        spans: list[list[int]] = []
        items: set[int] = set()
        state = run = 0
        for i, word in enumerate(words, 1):
            to = step[state].get(word)
            if to is None:
                while (state := link[state]) >= 0 and (to := step[state].get(word)) is None:
                    pass
                if to is None:
                    state = run = 0
                    continue
                run = length[state]
            state, run = to, run + 1
            if run < least:
                continue
            hit = 0
            if run >= full:
                hit = run
                items.update(window[state])
            for n, item in short[state]:
                if n <= run:
                    hit = max(hit, n)
                    items.add(item)
            if hit:
                start = i - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i])
        return spans, items


def _cut(words: list[bytes], window: int) -> Iterator[bytes]:
    """The words in pieces of bounded size that overlap by a window less a word, so that each window lies in one of them.

    Every piece of several has a window's length at least.
    """
    start, end, size = 0, 0, 0
    while end < len(words):
        if size + len(words[end]) >= SHARD_BYTES and end - start >= window:
            yield b" ".join(words[start:end])
            start = end - window + 1
            size = sum(len(w) + 1 for w in words[start:end])
        size += len(words[end]) + 1
        end += 1
    if words:
        yield b" ".join(words[start:])


def _pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int, nameless: bool) -> DataFrame:
    """(name, piece): the words of every item, long items cut."""
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).where(F.lit(nameless) | F.col(id_col).isNotNull()).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                for piece in _cut(words_of(text.as_py()), window):
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.string()), pa.array([piece], pa.binary())], ["name", "piece"])

    return rows.mapInArrow(run, "name string, piece binary")


def _shards(pieces: DataFrame) -> Iterator[list[tuple[str | None, bytes]]]:
    """The pieces, streamed partition by partition; a shard has SHARD_BYTES at most, or one piece."""
    shard, size = [], 0
    for name, piece in pieces.toLocalIterator():
        if shard and size + len(piece) > SHARD_BYTES:
            yield shard
            shard, size = [], 0
        shard.append((name, bytes(piece)))
        size += len(piece)
    if shard:
        yield shard


def _united(spans: list[list[int]], more: list[list[int]]) -> list[list[int]]:
    """The union of two sorted lists of disjoint spans; spans that touch become one."""
    if not spans or not more:
        return spans or more
    out: list[list[int]] = []
    for start, end in sorted(spans + more):
        if out and out[-1][1] >= start:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def match(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          window: int = 13, key_col: str = "doc_id", nameless: bool = False) -> DataFrame:
    """(key_col, n_words, hits, items): places of hit words, as disjoint ranges of word numbers, and the ids of the items hit, sorted.

    One row for each row of `docs`, null and empty texts and repeated keys included. Items without words hit
    nothing; equal items are all named. Items without an id hit nothing unless `nameless` is set: then their words count like
    any others, and a null at the end of `items` stands for all of them. Tasks build the automata of the shards and take one after another over
    the texts they hold, so the documents are read once and a worker has one automaton at a time.
    """
    sc = docs.sparkSession.sparkContext
    inputs = docs.select(F.col(key_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    shards = [sc.broadcast(shard) for shard in _shards(_pieces(benchmark, item_col, item_text_col, window, nameless))] or [sc.broadcast([])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, of = None, -1
        for held in _held(batches) if len(shards) > 1 else ([batch] for batch in batches):
            n = [[0] * len(batch) for batch in held]
            hits: list[list[list]] = [[[]] * len(batch) for batch in held]
            items: list[list] = [[()] * len(batch) for batch in held]
            # the automaton of the last shard is still there for the next texts
            for i in sorted(range(len(shards)), key=lambda i: i != of):
                if i != of:
                    automaton = None
                    automaton, of = Automaton(((name, piece.split()) for name, piece in _once(shards[i])), window), i
                for b, batch in enumerate(held):
                    for row, text in enumerate(batch.column(1)):
                        words = words_of(text.as_py())
                        spans, found = automaton.hits(words)
                        n[b][row] = len(words)
                        if spans:
                            hits[b][row] = _united(hits[b][row], spans)
                            items[b][row] = {*items[b][row], *(automaton.names[x] for x in found)}
            place = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            for b, batch in enumerate(held):
                places = [[{"start": start, "end": end} for start, end in spans] for spans in hits[b]]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n[b], pa.int64()), pa.array(places, pa.list_(place)),
                                                  pa.array([sorted(x, key=_null_last) for x in items[b]], pa.list_(pa.string()))], ["key", "n_words", "hits", "items"])

    schema = T.StructType().add("key", docs.schema[key_col].dataType)
    for field in T.StructType.fromDDL(SCHEMA):
        schema = schema.add(field)
    return inputs.mapInArrow(run, schema).withColumnRenamed("key", key_col)


def _null_last(name: str | None) -> tuple[bool, str]:
    return name is None, name or ""


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches by HELD_BYTES, so that a shard's automaton is built for many texts at once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _once(shared) -> list:
    """What is broadcast, which the worker doesn't keep."""
    value = shared.value
    if getattr(shared, "_path", None):
        del shared._value
    return value


def coverage(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])


def contaminated(n_words: Column, hits: Column, one_in: int = 20) -> Column:
    """True where hit words are at least one in `one_in`."""
    return F.coalesce((coverage(hits) > 0) & (coverage(hits) * one_in >= n_words), F.lit(False))
