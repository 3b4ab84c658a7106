"""Language identification by unigram pieces, marginalised over segmentations.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces, by the forward algorithm; a text's is the product over its words. The piece probabilities are
fitted by expectation maximisation on the word counts of labelled rows, which Spark gathers and re-estimates.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from widesift.session import cut_lineage

#: a longer run of letters is read as words of 32; the first pattern takes some numbers, such as fractions, for letters
WORD = re.compile(r"[^\W\d_]{1,32}")
LETTERS = regex.compile(r"\p{L}{1,32}")
EDGE = "▁"
UNDECIDED = "und"
#: rows per language, in expectation, that a model is fitted on at most
FIT_ROWS = 2000
ROUNDS = 3
#: added to every expected piece count; probability of a letter outside all pieces
SMOOTHING = 0.05
UNKNOWN = 1e-7
#: words a task counts at once; probabilities a task remembers, words by languages; words handled at once, by so many languages
MEMORY = 300_000
PROBABILITIES = 6_000_000
BLOCK = 4096
FEW_LANGUAGES = 64


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    text = text.lower()
    words = WORD.findall(text)
    return words if not words or "".join(words).isalpha() else LETTERS.findall(text)


def vocabulary(path: str) -> list[str]:
    """Pieces of letters, with or without the word-begin mark, of a sentencepiece model; lower-cased, sorted."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i)}
    return sorted({EDGE, *(p for p in pieces if p.removeprefix(EDGE).isalpha())})


@dataclass(frozen=True)
class Model:
    """languages; index: piece -> row of `table`, whose columns are the languages and whose last row is zero."""

    languages: list[str]
    index: dict[str, int]
    table: np.ndarray

    @classmethod
    def flat(cls, languages: list[str], pieces: list[str]) -> Model:
        table = np.full((len(pieces) + 1, len(languages)), 1 / max(1, len(pieces)))
        table[-1] = 0
        return cls(languages, {p: i for i, p in enumerate(pieces)}, table)

    def _places(self, words: list[str]) -> list[list[np.ndarray]]:
        """For words of one length: at [end - 1][length - 1] the rows of the pieces that end there."""
        texts, get = [EDGE + w for w in words], self.index.get
        longest = max(map(len, self.index))
        return [[np.fromiter((get(t[end - n:end], -1) for t in texts), np.int64, len(texts)) for n in range(1, min(end, longest) + 1)]
                for end in range(1, len(texts[0]) + 1)]

    def _forward(self, places) -> list[np.ndarray]:
        out = [np.ones((len(places[0][0]), len(self.languages)))]
        for end, rows in enumerate(places, 1):
            total = out[end - 1] * UNKNOWN
            for n, row in enumerate(rows, 1):
                total = total + out[end - n] * self.table[row]
            out.append(total)
        return out

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """A row of log probabilities by language for each word."""
        out = np.zeros((len(words), len(self.languages)))
        for block in self._blocks(words):
            out[block] = np.log(np.maximum(self._forward(self._places([words[i] for i in block]))[-1], 1e-300))
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in each language, given how often each language has each word."""
        uses = np.zeros_like(self.table)
        for block in self._blocks(words):
            places = self._places([words[i] for i in block])
            forward, end = self._forward(places), len(places)
            share = counts[block] / np.maximum(forward[-1], 1e-300)
            back: list = [None] * end + [np.ones_like(share)]
            for at in range(end - 1, -1, -1):
                back[at] = back[at + 1] * UNKNOWN
                for n in range(1, end - at + 1):
                    if n <= len(places[at + n - 1]):
                        back[at] = back[at] + self.table[places[at + n - 1][n - 1]] * back[at + n]
            for stop in range(1, end + 1):
                for n, row in enumerate(places[stop - 1], 1):
                    used = row >= 0
                    if used.any():
                        np.add.at(uses, row[used], (forward[stop - n] * self.table[row] * back[stop] * share)[used])
        uses[-1] = 0
        return uses

    def _blocks(self, words: list[str]) -> Iterable[list[int]]:
        """Places of words of one length, so many at once that the number of languages does not matter."""
        size = max(64, BLOCK * FEW_LANGUAGES // max(FEW_LANGUAGES, len(self.languages)))
        by_length = defaultdict(list)
        for i, word in enumerate(words):
            by_length[len(word)].append(i)
        for places in by_length.values():
            for i in range(0, len(places), size):
                yield places[i:i + size]

    def fitted(self, uses: np.ndarray) -> Model:
        table = uses + SMOOTHING
        table[-1] = 0
        return Model(self.languages, self.index, table / table.sum(axis=0))


def _word_counts(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(word, counts): how often the rows (lang, text) of each language have the word."""
    place = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts):
            keys = list(counts)
            return pa.RecordBatch.from_arrays([pa.array([k[1] for k in keys], pa.string()), pa.array([k[0] for k in keys], pa.int32()),
                                               pa.array(list(counts.values()), pa.int64())], ["word", "place", "n"])
        counts: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((place[lang], w) for w in words_of(text))
            if len(counts) > MEMORY:
                yield out(counts)
                counts = Counter()
        yield out(counts)

    counted = rows.mapInArrow(run, "word string, place int, n bigint")
    sums = counted.groupBy("word", "place").agg(F.sum("n").alias("n"))
    return sums.groupBy("word").agg(F.collect_list(F.struct("place", "n")).alias("counts"))


def fit(rows: DataFrame, pieces: list[str], key_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
        most_rows: int = FIT_ROWS, least_rows: int = 1, rounds: int = ROUNDS) -> Model:
    """Learns from the rows with a text and a language, `most_rows` of each language in expectation (by a hash of the key).

    Rows without a key, language or text teach nothing; no rows at all give a model without languages. Languages with fewer
    than `least_rows` rows are not learned; a model's size is the number of pieces times that of languages. Repeated
    rows count as often as they occur, texts are read whole, and other columns are ignored, whatever their names.
    """
    rows = rows.select(F.col(key_col).alias("key"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
    found = sorted(map(tuple, rows.groupBy("lang").count().where(F.col("count") >= least_rows).collect()))
    languages = [lang for lang, _ in found]
    model = Model.flat(languages, pieces)
    if not languages:
        return model
    # as many rows as there are learned languages
    shares = rows.sparkSession.createDataFrame([(lang, min(1.0, most_rows / n)) for lang, n in found], "lang string, share double")
    dealt = rows.join(F.broadcast(shares), "lang")
    sample = dealt.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("lang", "text")
    words = cut_lineage(_word_counts(sample, languages))
    for _ in range(rounds):
        model = model.fitted(_uses(words, model))
    return model


def _shared(words: DataFrame, model: Model):
    """The parts of a model for the workers, which may have no copy of this package to read a Model with."""
    return words.sparkSession.sparkContext.broadcast((model.languages, model.index, model.table))


def _uses(words: DataFrame, model: Model) -> np.ndarray:
    """Expected uses of every piece over all words; the driver gets one row for a piece and a language that uses it."""
    shared = _shared(words, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        uses = np.zeros_like(model.table)
        for batch in batches:
            counts = np.zeros((batch.num_rows, len(model.languages)))
            lists = batch.column(1)
            flat = lists.flatten()
            counts[np.repeat(np.arange(batch.num_rows), lists.value_lengths()), flat.field("place").to_numpy()] = flat.field("n").to_numpy()
            uses += model.expected(batch.column(0).to_pylist(), counts)
        piece, place = np.nonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(place), pa.array(uses[piece, place])], ["piece", "place", "uses"])

    uses = np.zeros_like(model.table)
    for piece, place, n in words.mapInArrow(run, "piece bigint, place bigint, uses double").groupBy("piece", "place").agg(F.sum("uses")).collect():
        uses[piece, place] = n
    return uses


def identify(docs: DataFrame, model: Model, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(key_col, lang_pred, score) for every row; score is the language's posterior probability.

    Texts that are null or have no letter are `und` with score 0, as is everything under a model without languages.
    Equal probabilities go to the first language in order. Every row gets its own result, repeated keys and texts too; a text is
    read whole, and other columns are ignored, whatever their names.
    """
    shared = _shared(docs, model)
    schema = T.StructType().add("key", docs.schema[key_col].dataType).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        memory = PROBABILITIES // max(20, len(model.languages))
        known: dict[str, int] = {}
        table = np.zeros((0, len(model.languages)))
        for batch in batches:
            names, scores = [], []
            for part in _by_bytes(batch.column(1)):
                texts = [words_of(t) if t else [] for t in part]
                if len(known) > memory:
                    known, table = {}, table[:0]
                new = list({w for words in texts for w in words if w not in known}) if model.languages else []
                known.update(zip(new, range(len(known), len(known) + len(new))))
                table = np.concatenate([table, model.log_probabilities(new)])
                for words in texts:
                    if not words or not model.languages:
                        names.append(UNDECIDED)
                        scores.append(0.0)
                        continue
                    total = table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0)
                    best = int(total.argmax())
                    names.append(model.languages[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             ["key", "lang_pred", "score"])

    rows = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key_col)


def _by_bytes(texts: pa.Array, most: int = 1 << 22) -> Iterator[list[str | None]]:
    """The texts in order, some megabytes at a time."""
    part, size = [], 0
    for text in texts:
        part.append(text.as_py())
        size += len(part[-1] or "")
        if size >= most:
            yield part
            part, size = [], 0
    yield part


def held_out(key: Column) -> Column:
    """True for the fifth of the keys that models are not fitted on."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
