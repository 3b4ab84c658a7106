"""Conversations rebuilt from quotations.

A message's lines carry quote levels. Runs of lines of one level are passages; the hash of a normalised passage is looked up
among the hashes of what earlier messages of the conversation said themselves (whole, by paragraph and by line). A passage
was said by the last message before the quoting one that has it, and the latest message quoted at the first level is what a
message replies to. Quotes are then removed, and every message gets the path of its replies, which orders a conversation so
that replies follow what they answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from widesift.llm.spans import let
from widesift.session import cut_lineage

#: the marks in front of a quoted line, and a line end
MARKS = r"^[ \t]*((?:>[ \t]?)+)"
LINE_END = r"\r\n|\r|\n"
PASSAGES = "array<struct<level:int,lines:array<string>>>"
#: code points of the shortest normalised text that links by itself
LEAST = 16


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normalised(text: Column) -> Column:
    """Lower-cased, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passages(text: Column) -> Column:
    """array<struct<level, lines>>: runs of lines of one level without their marks; level 0 is the message's own text."""
    lines = F.transform(F.split(text, LINE_END, -1), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")))
    starts = lambda rows: F.filter(F.sequence(F.lit(1), F.size(rows)), lambda i: (i == 1) | (
        F.get(rows, i - 1)["level"] != F.get(rows, i - 2)["level"]))

    def cut(rows: Column) -> Column:
        return let(starts(rows), lambda at: F.transform(at, lambda s, k: F.struct(
            F.get(rows, s - 1)["level"].alias("level"),
            F.transform(F.slice(rows, s, F.coalesce(F.get(at, k + 1), F.size(rows) + 1) - s), lambda r: r["line"]).alias("lines"))))

    return let(lines, cut)


def _hashes(texts: Column, least: int) -> Column:
    """Distinct addresses of normalised texts of at least `least` code points."""
    return F.array_distinct(F.transform(F.filter(F.transform(texts, normalised), lambda t: F.length(t) >= max(1, least)), lambda t: F.unhex(F.sha2(t, 256))))


def link(messages: DataFrame, least: int = LEAST, text_col: str = "text", conversation_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """`messages` with own, n_quotes, n_linked, parent, depth and path added.

    own is the text without quotes (null for a null text), n_quotes the number of quoted passages at any level, n_linked how many
    of them an earlier message of the conversation said; parent is the latest such message among those quoted at the first
    level, null if there is none; path lists the turns from the first message of the thread to this one, depth is the number
    of replies in it. Ordering by (conversation, path) puts replies behind what they answer. Passages and lines of fewer than
    `least` code points ("thanks") link with nothing. Messages without conversation or turn are linked with nothing. Rows that
    differ in their text are messages of their own, whatever their turn; repeated rows are kept and get equal results, and of
    several texts at the turn of a parent one is taken by its hash. Columns with the added names are replaced, all others
    kept. An empty table gives an empty one; a text is read whole.
    """
    added = ["own", "n_quotes", "n_linked", "parent", "depth", "path"]
    turn_kind = messages.schema[turn_col].dataType.simpleString()
    text = F.col("row")[text_col]
    rows = messages.drop(*added).select(F.struct("*").alias("row"), F.col(conversation_col).alias("conv"), F.col(turn_col).alias("turn"))
    # a message of a conversation: its turn and what it says
    rows = rows.withColumn("node", F.when(F.col("conv").isNotNull() & F.col("turn").isNotNull(), F.struct("turn", F.xxhash64(text).alias("id"))))
    rows = rows.withColumn("parts", F.when(F.contains(text, F.lit(">")), passages(text)).otherwise(
        F.array(F.struct(F.lit(0).alias("level"), F.array(F.coalesce(text, F.lit(""))).alias("lines"))).cast(PASSAGES)))
    said = F.flatten(F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["lines"]))
    rows = rows.withColumn("own", F.when(F.exists("parts", lambda p: p["level"] > 0), F.trim(F.array_join(said, "\n"), F.lit("\n"))).otherwise(text))
    quotes = (rows.select("conv", "node", F.posexplode("parts").alias("at", "p")).where("p.level > 0")
              .withColumn("whole", F.array_append(F.col("p.lines"), F.array_join("p.lines", "\n")))
              .where(F.exists("whole", lambda t: normalised(t) != ""))
              .select("conv", "node", "at", "p.level", _hashes(F.col("whole"), least).alias("hashes")).distinct())
    quotes = cut_lineage(quotes)
    own = F.concat(F.array("own"), F.split("own", r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)"), F.split("own", LINE_END))
    holders = rows.where(F.col("node").isNotNull()).select("conv", "node", F.explode(_hashes(own, least)).alias("hash")).distinct()
    wanted = quotes.where(F.col("node").isNotNull()).select("conv", "node", "at", "level", F.explode("hashes").alias("hash"))
    held = holders.join(wanted.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    # in the order of turns, quotations before what is said in the same turn: the last holder so far
    both = wanted.select("conv", "hash", F.col("node.turn").alias("turn"), F.lit(0).alias("kind"), "node", "at", "level").unionByName(
        held.select("conv", "hash", F.col("node.turn").alias("turn"), F.lit(1).alias("kind"), "node", F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("level")))
    so_far = Window.partitionBy("conv", "hash").orderBy("turn", "kind", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("source", F.last(F.when(F.col("kind") == 1, F.col("node")), ignorenulls=True).over(so_far))
    found = met.where((F.col("kind") == 0) & F.col("source").isNotNull()).groupBy("conv", "node", "at").agg(
        F.max(F.when(F.col("level") == 1, F.col("source"))).alias("source"), F.lit(True).alias("met"))
    links = quotes.join(found, ["conv", "node", "at"], "left").groupBy("conv", "node").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("met").alias("n_linked"), F.max("source").alias("parent"))
    links = cut_lineage(links)
    paths = _paths(links.where("parent IS NOT NULL AND node IS NOT NULL").select("conv", "node", "parent"))
    facts = cut_lineage(links.where("node IS NOT NULL").join(paths, ["conv", "node"], "left"))
    # rows outside any conversation are counted by themselves
    alone = F.size(F.filter("parts", lambda p: (p["level"] > 0) & F.exists(p["lines"], lambda t: normalised(t) != ""))).cast("bigint")
    out = rows.select("row", "conv", "node", "turn", "own", F.when(F.col("node").isNull(), alone).alias("alone")).join(facts, ["conv", "node"], "left")
    path = F.coalesce("path", F.array(F.col("turn").cast(turn_kind)))
    return out.select("row.*", "own", F.coalesce("n_quotes", "alone", F.lit(0).cast("bigint")).alias("n_quotes"), F.coalesce("n_linked", F.lit(0).cast("bigint")).alias("n_linked"),
                      F.col("parent.turn").alias("parent"), (F.size(path) - 1).alias("depth"), path.alias("path"))


def _paths(replies: DataFrame) -> DataFrame:
    """(conv, node, path) for messages with a parent; the known stretch of each path doubles with every round."""
    state = cut_lineage(replies.select("conv", "node", F.col("parent").alias("top"), F.array("parent.turn", "node.turn").alias("path"), F.lit(True).alias("open")))
    while not state.where("open").isEmpty():
        above = state.select("conv", F.col("node").alias("top"), F.col("top").alias("above"), F.col("path").alias("front"), F.col("open").alias("further"))
        state = cut_lineage(state.join(above, ["conv", "top"], "left").select(
            "conv", "node", F.coalesce("above", "top").alias("top"),
            F.when(F.col("front").isNull(), F.col("path")).otherwise(F.concat("front", F.slice("path", 2, F.size("path")))).alias("path"),
            F.coalesce("further", F.lit(False)).alias("open")))
    return state.select("conv", "node", "path")


def formatted(role: Column, own: Column) -> Column:
    """A message as a chat line block: the role in marks, then the text; a null role is `user`, a null text empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("user")), F.lit("|>\n"), F.coalesce(own, F.lit("")))
