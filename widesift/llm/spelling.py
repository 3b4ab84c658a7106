"""Spelling variants by finite-state composition.

The vocabulary's acceptor is composed with a transducer of exactly one edit and with the acceptor again; an accepted pair is a
pair of words that differ by one inserted, deleted or replaced code point. The composition starts in the pair of initial states
and stays on its diagonal up to the edit, so it falls apart by what the diagonal has read: a prefix. Prefixes of many words are
split one code point further. What composes within a prefix of few words runs in one task, over the minimised acceptor of
those words. Edits at the end of a split prefix are arcs that leave the diagonal before a partition begins; after such an arc both
acceptors have to read the same, so these pairs are equal keys: the prefix, what the arc reads, the rest of the word.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from widesift.session import broadcast_if_bounded, cut_lineage

#: letters of a word
RUN = "[A-Za-zÀ-ÿ]+"
#: words that one task composes at most
MOST_WORDS = 8192
#: further code points of a prefix that are looked at in one round
STEP = 4


def vocabulary(docs: DataFrame, least_length: int = 5, least_n: int = 3, one_in: int = 97, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(word, n): words of at least `least_length` code points that occur `least_n` times or more in all texts.

    A run of letters with A-Z lower-cased loses one code point where `one_in` divides the crc32 of "<key>:<run>" (typing errors
    for texts without any); without a key the part before the colon is empty. Null and empty texts hold no word. Repeated rows
    count as often as they occur; other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(key_col).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("run"))
    run = F.col("run")
    # in ASCII text lower() changes A-Z only, and much faster
    low = F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, string.ascii_uppercase, string.ascii_lowercase))
    rows = rows.where(F.length(run) >= least_length).withColumn("run", low)
    rows = rows.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def _prefix(length) -> Column:
    return F.substring("word", F.lit(1), length)


def partitioned(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, n, depth): the shortest prefix of a word that at most `most` words share has `depth` code points.

    Where all prefixes of a word, itself included, are shared by more, `depth` is one more than its length.
    """
    settled, rest, start = None, words, 0
    while True:
        levels = rest.select("word", "n", F.explode(F.sequence(F.lit(start), F.least(F.length("word"), F.lit(start + STEP - 1)))).alias("level"))
        levels = levels.withColumn("prefix", _prefix(F.col("level")))
        split = levels.groupBy("prefix").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") > most).select("prefix", F.lit(True).alias("split"))
        known = levels.join(broadcast_if_bounded(split), "prefix", "left")
        known = cut_lineage(known.groupBy("word", "n").agg(F.coalesce(F.max(F.when(F.col("split"), F.col("level"))) + 1, F.lit(start)).alias("depth")))
        # still split at the last level looked at, with code points left to split by
        on = (F.col("depth") == start + STEP) & (F.length("word") >= start + STEP)
        done = known.where(~on)
        settled = done if settled is None else settled.unionByName(done)
        rest = known.where(on).select("word", "n")
        if rest.isEmpty():
            return settled
        start += STEP


class Acceptor:
    """The minimal deterministic acceptor of sorted words: arcs and finality by state; state 0 reads nothing more."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [True]
        register: dict[tuple, int] = {(True, ()): 0}
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]  # of the last word, not yet registered
        last = ""

        def fold(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs.items()))
                state = register.get(key)
                if state is None:
                    state = register[key] = len(self.arcs)
                    self.arcs.append(arcs)
                    self.final.append(final)
                path[-1][1][last[len(path) - 1]] = state

        for word in words:
            same = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                same += 1
            fold(same)
            path += [(False, {}) for _ in range(len(word) - same)]
            path[-1] = (True, path[-1][1])
            last = word
        fold(0)
        self.arcs.append(path[0][1])
        self.final.append(path[0][0])
        self.initial = len(self.arcs) - 1

    def _equal(self, p: int, q: int) -> Iterator[tuple | None]:
        """What both states accept, as (rest, code point) chains."""
        stack: list[tuple[int, int, tuple | None]] = [(p, q, None)]
        while stack:
            p, q, read = stack.pop()
            if self.final[p] and self.final[q]:
                yield read
            after = self.arcs[q]
            for c, to in self.arcs[p].items():
                if c in after:
                    stack.append((to, after[c], (read, c)))

    def one_edit(self) -> Iterator[tuple[str, str]]:
        """Pairs of accepted words that are one edit apart, each pair once: the edit is made where the two first differ."""
        stack: list[tuple[int, tuple | None]] = [(self.initial, None)]
        while stack:
            state, read = stack.pop()
            arcs = list(self.arcs[state].items())
            for i, (c, to) in enumerate(arcs):
                stack.append((to, (read, c)))
                # c is inserted: the other word goes on from here with something else
                if self.final[state] and self.final[to]:
                    yield _spelt(read, c, None), _spelt(read, "", None)
                for d, other in self.arcs[to].items():
                    if d != c and d in self.arcs[state]:
                        for rest in self._equal(other, self.arcs[state][d]):
                            yield _spelt(read, c + d, rest), _spelt(read, d, rest)
                for d, other in arcs[i + 1:]:  # c is replaced by d
                    for rest in self._equal(to, other):
                        yield _spelt(read, c, rest), _spelt(read, d, rest)


def _unchained(chain: tuple | None) -> str:
    found = []
    while chain:
        chain, c = chain
        found.append(c)
    return "".join(reversed(found))


def _spelt(before: tuple | None, middle: str, after: tuple | None) -> str:
    return _unchained(before) + middle + _unchained(after)


def _compose(words: list[str], counts: list[int], skip: int) -> list[tuple[str, int, int, str]]:
    """(word, near words, largest n of one, that one) for words of one prefix of `skip` code points."""
    if len(words) < 2:
        return []
    n = dict(zip(words, counts))
    prefix = words[0][:skip]
    near: dict[str, tuple[int, int, str]] = {}
    for a, b in Acceptor(sorted(w[skip:] for w in words)).one_edit():
        a, b = prefix + a, prefix + b
        for x, y in ((a, b), (b, a)):
            number, best, form = near.get(x, (0, 0, ""))
            better = n[y] > best or n[y] == best and y < form
            near[x] = (number + 1, n[y], y) if better else (number + 1, best, form)
    return [(w, *found) for w, found in near.items()]


NEAR = "word string, n_near bigint, form_n bigint, form string"


def _within(rows: DataFrame) -> DataFrame:
    """Near words that share a partition's prefix."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, depth, words, counts = None, 0, [], []
        columns = [f.split()[0] for f in NEAR.split(", ")]
        for frame in frames:
            found = []
            for p, d, word, n in zip(frame.part, frame.depth, frame.word, frame.n):
                if p != part:
                    found += _compose(words, counts, depth)
                    part, depth, words, counts = p, d, [], []
                words.append(word)
                counts.append(n)
            yield pd.DataFrame(found, columns=columns)
        yield pd.DataFrame(_compose(words, counts, depth), columns=columns)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.where(F.length("word") >= F.col("depth")).withColumn("part", _prefix(F.col("depth")))
    return grouped.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(run, NEAR)


def _across(rows: DataFrame) -> DataFrame:
    """Near words that part at the end of a prefix that was split."""
    split = rows.where("depth > 0").select("word", "n", F.explode(F.sequence(F.lit(0), F.least(F.col("depth"), F.length("word")) - 1)).alias("level"))
    left, rest = _prefix(F.col("level")), F.substring("word", F.col("level") + 2, F.length("word"))
    # replaced: words that are equal but for one place are at most as many as there are letters
    groups = split.groupBy(F.concat(left, F.lit("*"), rest).alias("key")).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "word"))).alias("all")).where(F.size("all") > 1)
    best = F.when(F.col("one.word") == F.col("all")[0]["word"], F.col("all")[1]).otherwise(F.col("all")[0])
    members = groups.select("all", F.explode("all").alias("one")).withColumn("best", best)
    replaced = members.select("one.word", (F.size("all") - 1).cast("bigint").alias("n_near"), (-F.col("best.less")).alias("form_n"), F.col("best.word").alias("form"))
    longer = split.select(F.col("word").alias("long"), F.col("n").alias("long_n"), "level", F.substring("word", F.col("level") + 1, F.lit(1)).alias("c"), F.concat(left, rest).alias("word"))
    pairs = longer.join(rows.select("word", "n"), "word").where(F.substring("word", F.col("level") + 1, F.lit(1)) != F.col("c"))
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("word"), F.lit(1).cast("bigint").alias("n_near"), F.col("long_n").alias("form_n"), F.col("long").alias("form")),
        F.struct(F.col("long").alias("word"), F.lit(1).cast("bigint").alias("n_near"), F.col("n").alias("form_n"), F.col("word").alias("form")))).alias("near"))
    return replaced.unionByName(both.select("near.*"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of the chain of forms. Each round doubles the steps that a pointer has taken."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def group_variants(words: DataFrame, ratio: int = 2, most: int = MOST_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for a vocabulary (word, n) of distinct words.

    `form` is the near word of largest n, the smallest one of equals, where its n is at least `ratio` times the word's (else null, as
    is `form_n`); `ratio` is above 1. `root` is where the chain of forms ends. `most` bounds the words of a task. An empty vocabulary
    gives an empty table; words may be of any length, a task holds those of one prefix.
    """
    words = cut_lineage(words.select("word", "n"))
    rows = cut_lineage(partitioned(words, most))
    near = _within(rows).unionByName(_across(rows))
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    found = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
