"""Personal data: fixed kinds by pattern, and further identifiers by contexts that the fixed kinds teach.

Entities of the fixed kinds are seeds. The word in front of an identifier-like token is a lexical pattern, and patterns and
tokens form a graph. A pattern's confidence is the share of all its occurrences in the corpus that are followed by a token
believed in; a token is believed in as a seed, or as far as the patterns in front of it are. Spark repeats both steps, and
what stands after a pattern of high confidence is taken for an identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from widesift.llm.blob_ledger import address
from widesift.llm.spans import joined, let, matches
from widesift.session import broadcast_if_bounded, cut_lineage

#: Fixed values. A run of digits or name characters is entered at its start only, or where the match before it ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
ENTITIES = "array<struct<kind:string,start:bigint,end:bigint,text:string>>"
#: a token with a digit or an at sign; one that counts as an identifier has five of them
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
MARKS = 5
#: distinct tokens a pattern needs, its least confidence, and rounds of scoring
SUPPORT = 5
CONFIDENCE = 0.5
ROUNDS = 3


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True where a string of digits passes the check: every second digit from the right counts double."""
    places = F.sequence(F.lit(1), F.length(digits))
    worth = lambda at: F.substring(F.reverse(digits), at, F.lit(1)).cast("int") * F.when(at % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0))
    return total % 10 == 0


def _valid_ip(text: Column) -> Column:
    """True where each part is at most 255, however many zeros lead it."""
    return F.forall(F.split(text, r"\."), lambda part: F.length(F.ltrim(part, F.lit("0"))).between(1, 3)
                    & (F.ltrim(part, F.lit("0")).try_cast("int") <= 255) | (F.ltrim(part, F.lit("0")) == ""))


def _valid_card(text: Column) -> Column:
    digits = _digits(text)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)


def _kept(text: Column, kind: str, pattern: str, valid=None) -> Column:
    found = matches(text, pattern)
    if valid is not None:
        found = F.filter(found, lambda m: valid(m["text"]))
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text")))


def entities(text: Column) -> Column:
    """array<struct<kind, start, end, text>> of the fixed kinds, by kind as listed, then start; none for a null text."""
    none = F.array().cast(ENTITIES)
    with_mark = lambda mark, spans: F.when(F.contains(text, F.lit(mark)), spans).otherwise(none)
    return F.concat(with_mark("@", _kept(text, "email", EMAIL)), with_mark(".", _kept(text, "ip", IP, _valid_ip)),
                    _kept(text, "card", CARD, _valid_card),
                    with_mark("+", _kept(text, "phone", PHONE, lambda t: F.length(_digits(t)).between(9, 15))))


def _candidates(text: Column) -> Column:
    """array<struct<start, end, left, token, first, last>>: tokens after a word; `token`, from `first` to `last`, is what is left without punctuation around."""
    word = lambda gap: F.regexp_extract(gap, r"(?<!\S)(\S++)\s++\z", 1)
    # between two tokens stand whole words, so white space alone means that the token before is the word in front
    left = lambda gap, last: F.lower(let(word(gap), lambda w: F.when(w != "", w).otherwise(F.coalesce(last, F.lit("")))))
    front = lambda t: F.length(F.regexp_extract(t, r"^[^A-Za-z0-9@+]*", 0))
    core = lambda t: F.regexp_replace(t, r"^[^A-Za-z0-9@+]+|[^A-Za-z0-9]+$", "")
    found = F.filter(matches(text, TOKEN, left), lambda m: m["before"] != "")
    return F.transform(found, lambda m: let(core(m["text"]), lambda c: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["before"].alias("left"), c.alias("token"),
        (m["start"] + front(m["text"])).alias("first"), (m["start"] + front(m["text"]) + F.length(c)).alias("last"))))


def tokens_of(rows: DataFrame) -> DataFrame:
    """(number, blob, left, start, end, token, seed): candidates outside entities or (seed) with the first kind of entity that begins in them.

    rows: (number, blob, entities, candidates). Candidates and entities of a text are put in the order of their places, where
    a running maximum says whether an entity is open, and the last candidate is the one that an entity begins in; so a text
    costs what sorting them costs.
    """
    token = "struct<start:bigint,end:bigint,left:string,token:string,first:bigint,last:bigint>"
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    both = F.concat(
        F.transform("candidates", lambda t: F.struct(t["start"].alias("at"), F.lit(0).cast("bigint").alias("rank"), t.alias("t"), F.lit(None).cast("bigint").alias("end"), F.lit(None).cast("string").alias("text"))),
        F.transform("entities", lambda s: F.struct(s["start"].alias("at"), rank(s).alias("rank"), F.lit(None).cast(token).alias("t"), s["end"].alias("end"), s["text"].alias("text"))))
    events = rows.where(F.size("candidates") > 0).select("number", "blob", F.explode(both).alias("e")).select("number", "blob", "e.*")
    before = Window.partitionBy("number").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = events.withColumns({"open": F.max("end").over(before), "owner": F.last("t", ignorenulls=True).over(before)})
    placed = placed.where(F.col("owner").isNotNull() & (F.col("t").isNotNull() | (F.col("at") < F.col("owner.end"))))
    entity = F.when(F.col("t").isNull(), F.struct("rank", "at", "end", "text"))
    # at a candidate's own row no entity that begins with it is counted yet
    inside = F.max(F.when(F.col("t").isNotNull(), F.coalesce(F.col("open") > F.col("at"), F.lit(False))))
    found = placed.groupBy("number", "blob", F.col("owner.start").alias("place")).agg(F.max("owner").alias("o"), F.min(entity).alias("s"), inside.alias("inside"))
    seed = F.col("s").isNotNull()
    named = found.where(~F.col("inside")).select("number", "blob", F.col("o.left").alias("left"), F.col("o.first").alias("start"), F.col("o.last").alias("end"),
                                                 F.when(seed, F.col("s.text")).otherwise(F.col("o.token")).alias("token"), seed.alias("seed"))
    return named.where(F.col("seed") | (F.length(F.regexp_replace("token", "[^0-9@]", "")) >= MARKS))


def patterns(tokens: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """(left, confidence): words in front of tokens, scored over the graph of (left, token) and all words of the corpus."""
    pairs = cut_lineage(tokens.groupBy("left", "token").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")))
    lefts = cut_lineage(pairs.groupBy("left").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= SUPPORT).select("left"))
    words = texts.select(F.explode(F.split(F.lower(text_col), r"\s+")).alias("left"))
    totals = cut_lineage(words.join(broadcast_if_bounded(lefts, lefts), "left", "left_semi").groupBy("left").agg(F.count(F.lit(1)).alias("total")))
    edges = cut_lineage(pairs.join(totals, "left"))
    belief = edges.groupBy("token").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    for _ in range(ROUNDS):
        believed = edges.join(belief, "token")
        scored = cut_lineage(believed.groupBy("left").agg(
            (F.sum(F.col("n") * F.col("belief")) / F.first("total")).alias("confidence"), F.sum((F.col("belief") >= CONFIDENCE).cast("int")).alias("k"))
            .where((F.col("k") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("left", F.least("confidence", F.lit(1.0)).alias("confidence")))
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.coalesce("confidence", F.lit(0.0)), F.lit(1e-9)))))
        belief = edges.join(scored, "left", "left").groupBy("token").agg(
            F.greatest(F.max(F.col("seed").cast("double")), 1 - doubt).alias("belief"))
    return scored


def find_personal(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(key_col, base, found) for every row: entities of the fixed kinds, and identifiers (kind `context`) that contexts reveal.

    Both are array<struct<kind, start, end>> in code points, ends exclusive; `found` is sorted by start and lies outside
    `base`. Null and empty texts have none. Equal texts have equal results; repeated keys keep a row each; other columns are
    ignored, whatever their names. A text is read whole; very many entities in one cost what sorting them costs.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(key_col).alias("key"), address(text).alias("blob"), F.monotonically_increasing_id().alias("number"), entities(text).alias("entities"),
                       _candidates(text).alias("candidates"))
    rows = cut_lineage(rows)
    tokens = cut_lineage(tokens_of(rows))
    scored = patterns(tokens, docs, text_col)
    new = tokens.where(~F.col("seed")).join(scored, "left", "left_semi")
    place = F.struct(F.col("start"), F.col("end"))
    new = cut_lineage(new.groupBy("blob").agg(F.array_sort(F.collect_set(place)).alias("places")))
    found = F.transform("places", lambda s: F.struct(F.lit(CONTEXT).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.transform("entities", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.drop("candidates").join(new, "blob", "left").select(
        F.col("key").alias(key_col), base.alias("base"), F.coalesce(found, F.array().cast(SPANS)).alias("found"))


def digest(base: Column, found: Column) -> dict[str, Column]:
    """Counts by kind, the hash of the joined entities, and all spans joined."""
    n = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return {f"n_{kind}": n(kind) for kind in KINDS} | {"base_sha256": F.sha2(joined(base), 256), "spans": joined(F.concat(base, found))}
