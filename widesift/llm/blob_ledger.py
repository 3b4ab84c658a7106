"""Secret scans with a ledger of what has been scanned.

Every version of every path is addressed by the hash of its content. A ledger holds a row for each pair of a content and
a rule version that has been scanned, with what was found; a run scans only pairs that the ledger lacks, once however many
paths and versions share a content, and joins findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from widesift.llm.spans import joined, matches, replaced
from widesift.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the group whose length counts, and the least length. A change needs a new version."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed values
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (Rule("assign", 1, ASSIGN, 2, 6), Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20), Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24))
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def address(content: Column) -> Column:
    """Address of a content; a null one counts as empty."""
    return F.unhex(F.sha2(F.coalesce(content, F.lit("")), 256))


def _spans(content: Column, rule: Rule) -> Column:
    found = matches(content, rule.pattern)
    counted = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) if rule.group else F.length(m)
    kept = F.filter(found, lambda m: counted(m["text"]) >= rule.least)
    return F.transform(kept, lambda m: F.struct(F.lit(rule.kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def scan(history: DataFrame, content_col: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rule, spans): one for every unseen pair of a content in `history` and a rule version."""
    blobs = history.select(address(F.col(content_col)).alias("blob"), F.col(content_col).alias("content")).dropDuplicates(["blob"])
    every = F.array(*(F.lit(r.key) for r in rules))
    if ledger is None:
        blobs = blobs.withColumn("due", every)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("due", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
        blobs = blobs.where(F.size("due") > 0)
    scanned = [F.struct(F.lit(r.key).alias("rule"), F.when(F.array_contains("due", r.key), _spans(F.col("content"), r)).alias("spans"))
               for r in rules]
    return (blobs.select("blob", F.explode(F.array(*scanned)).alias("x")).select("blob", "x.rule", "x.spans")
            .where(F.col("spans").isNotNull()))


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): spans of the rules' present versions by start, then kind as listed; contents without a finding have no row."""
    order = reduce(lambda rest, i: F.when(F.col("s.kind") == rules[i].kind, i).otherwise(rest), reversed(range(len(rules))), F.lit(len(rules)))
    spans = ledger.where(F.col("rule").isin([r.key for r in rules])).select("blob", F.explode("spans").alias("s"))
    struct = F.struct(F.col("s.start").alias("start"), order.alias("order"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"))
    grouped = spans.select("blob", struct.alias("s")).groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("s"))
    return grouped.select("blob", F.transform("s", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
                          .alias("spans"))


def find_secrets(history: DataFrame, content_col: str = "text", ledger: DataFrame | None = None,
                 rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """`history` with the columns blob and spans added (spans empty where nothing is found), and the ledger brought up to date.

    `history` has a row for each version of each path, with any columns; columns named blob or spans are replaced. Null
    contents count as empty ones. Repeated rows are kept. Append the second result's new rows to a table to scan less next time.
    """
    fresh = cut_lineage(scan(history, content_col, ledger, rules))
    full = fresh if ledger is None else ledger.select("blob", "rule", "spans").unionByName(fresh)
    # written, so that a content that many paths share can be split in the join
    found = cut_lineage(findings(full, rules))
    addressed = history.drop("blob", "spans").withColumn("blob", address(F.col(content_col)))
    out = addressed.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    return out, full


def redacted(found: DataFrame, content_col: str = "text", by: str = "[secret]") -> DataFrame:
    """`find_secrets`' first result with every finding in the content replaced, and blob and spans dropped."""
    return found.withColumn(content_col, replaced(F.col(content_col), F.col("spans"), by)).drop("blob", "spans")


def digest(spans: Column) -> dict[str, Column]:
    """Counts by kind, the hash of the joined spans and the joined spans."""
    n = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return {"n_assign": n("assign"), "n_access": n("access"), "n_hex": n("hex"), "base_sha256": F.sha2(joined(spans), 256), "spans": joined(spans)}
