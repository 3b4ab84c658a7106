"""Language identification and decontamination against plain Python."""

import itertools
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from widesift.llm import catalog, contamination, language

PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "bab"]
    rng = np.random.default_rng(0)
    model = language.Model(["x", "y"], {p: i for i, p in enumerate(pieces)}, np.vstack([rng.random((len(pieces), 2)), [[0, 0]]]))
    for word in ("a", "ab", "abab", "babba", "abz"):
        text = language.EDGE + word
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts, at = [], 0
            for i, cut in enumerate([*cuts, 1], 1):
                if cut:
                    parts.append(text[at:i])
                    at = i
            p = np.ones(2)
            for part in parts:
                p = p * (model.table[model.index[part]] if part in model.index else 0) + p * (language.UNKNOWN if len(part) == 1 else 0)
            total += p
        assert np.allclose(np.exp(model.log_probabilities([word])[0]), total, rtol=1e-9)
        uses = model.expected([word], np.ones((1, 2)))  # every letter lies in one piece or is unknown
        lengths = np.array([len(p) for p in pieces] + [0])[:, None]
        assert (uses * lengths).sum(axis=0).max() <= len(text) + 1e-9


def test_words_are_runs_of_letters():
    texts = ["½ ² ① Ⅷ", "a½b x² é①", "三 〇", "a_b1c", "x" * 70, "\u0661 \u0967", "Ünï-cödé", "", "ªº ǆ ʰ", "अआ कि"]
    for text in texts:
        runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        assert language.words_of(text) == [r[i:i + 32] for r in runs for i in range(0, len(r), 32)]


def test_many_languages(spark):
    rows = [(i, f"common word{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghijklmnopqrstuvwxyz'[i // 26]}", f"l{i:03d}") for i in range(600)] * 2
    docs = spark.createDataFrame([(n, t, lang) for n, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.fit(docs, sorted({"▁", "▁common", "▁word", *"abcdefghijklmnopqrstuvwxyz"}), rounds=2)
    assert len(model.languages) == 600
    assert language.fit(docs.where("doc_id < 605"), ["▁"], least_rows=2, rounds=1).languages == [f"l{i:03d}" for i in range(5)]
    got = language.identify(docs.limit(40), model).collect()
    assert len(got) == 40 and all(0 < r.score <= 1 for r in got)


def test_expected_uses_are_those_of_all_segmentations():
    """The expectation step: every segmentation counts by its share of the word's probability."""
    pieces = ["▁", "▁a", "a", "b", "ab", "ba"]
    rng = np.random.default_rng(1)
    model = language.Model(["x", "y"], {p: i for i, p in enumerate(pieces)}, np.vstack([rng.random((len(pieces), 2)), [[0, 0]]]))
    words, counts = ["ab", "aba", "bz", "baab"], rng.random((4, 2)) * 5
    want = np.zeros((len(pieces) + 1, 2))
    for word, n in zip(words, counts):
        text, ways = language.EDGE + word, []
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            places = [0, *(i for i, c in enumerate(cuts, 1) if c), len(text)]
            parts = [text[i:j] for i, j in zip(places, places[1:])]
            # a part of one letter is a piece or an unknown letter
            for kinds in itertools.product(*[(["piece"] if p in model.index else []) + (["unknown"] if len(p) == 1 else []) for p in parts]):
                chance = np.prod([model.table[model.index[p]] if k == "piece" else np.full(2, language.UNKNOWN) for p, k in zip(parts, kinds)], axis=0)
                ways.append((chance, [p for p, k in zip(parts, kinds) if k == "piece"]))
        total = sum(c for c, _ in ways)
        for chance, used in ways:
            for p in used:
                want[model.index[p]] += n * chance / total
    assert np.allclose(model.expected(words, counts), want)


def test_equal_probabilities_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id long, text string, lang string")
    model = language.fit(docs, ["▁", *"ademorsw"])
    [row] = language.identify(docs.limit(1), model).collect()
    assert row.lang_pred == "a" and abs(row.score - 0.5) < 1e-9


def test_languages_of_held_out_rows(spark):
    docs = catalog.table(spark, "/root/testdata/sf0.01", "documents")
    found = catalog.op8_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in found if r.held_out]
    assert len(found) == docs.count() and 100 < len(out) < 300
    assert np.mean([r.lang_pred == r.lang for r in out]) >= 0.97 and all(0 <= r.score <= 1 for r in found)


def test_language_edges(spark):
    rows = [(i, t, lang, 1.0) for i, (t, lang) in enumerate(
        [("the and of with", "en"), ("der die und nicht", "de"), ("the of", None), (None, "en"), ("", "de"), ("12 !!", "en"), ("DER und", "de"), ("the", "en")] * 3)]
    docs = spark.createDataFrame(rows + [(None, "the", "de", 1.0)], "doc_id long, text string, lang string, score double")
    model = language.fit(docs, language.vocabulary(PIECES))
    assert model.languages == ["de", "en"]
    probe = spark.createDataFrame([(1, "und der"), (2, None), (3, ""), (4, "12 ½ %%"), (5, "with the"), (6, "x" * 300_000), (5, "with the")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(probe, model).collect()]
    assert [g[1] for g in got[:5]] == ["de", "und", "und", "und", "en"] and got[4] == got[6] and got[1][2] == 0
    none = language.fit(docs.limit(0), language.vocabulary(PIECES))
    assert {r.lang_pred for r in language.identify(probe, none).collect()} == {"und"}
    assert language.identify(probe.limit(0), model).count() == 0


def slow_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def slow_match(items, text, window):
    hit, named, words = set(), set(), slow_words(text)
    for name, item in items:
        own = slow_words(item)
        n = min(window, len(own))
        grams = {tuple(own[k:k + n]) for k in range(max(1, len(own) - window + 1))} if own else set()
        for k in range(len(words) - n + 1) if own else ():
            if tuple(words[k:k + n]) in grams:
                hit.update(range(k, k + n))
                named.add(str(name))
    return len(words), len(hit), sorted(named)


def test_automaton_by_brute_force():
    for seed in range(400):
        r = random.Random(seed)
        letters = "abc"[:r.randint(1, 3)]
        items = [(k, " ".join(r.choices(letters, k=r.randint(0, 9)))) for k in range(r.randint(0, 6))]
        text, window = " ".join(r.choices(letters + "d", k=r.randint(0, 25))), r.randint(1, 5)
        automaton = contamination.Automaton([(n, contamination.words_of(t.encode())) for n, t in items], window)
        words = contamination.words_of(text.encode())
        hits, named = automaton.hits(words)
        assert (len(words), sum(b - a for a, b in hits), sorted(automaton.names[i] for i in named)) == slow_match(items, text, window)


@pytest.mark.parametrize("shard", [1 << 20, 1])
def test_match_with_one_and_many_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(contamination, "SHARD_BYTES", shard)
    r = random.Random(2)
    items = [(i, " ".join(r.choices(["ab", "Cd", "é", "x1"], k=n))) for i, n in enumerate([3, 0, 14, 20, 14])] + [(9, None), (2, "other words"), (None, "ab")]
    texts = [None, "", "no match", items[3][1].upper().replace("É", "é") + " tail", "x " * 30_000 + items[2][1], items[0][1]] + [
        " ".join(r.choices(["ab", "cd", "é", "x1"], k=60)) for _ in range(10)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, hits string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: (x.n_words, sum(h.end - h.start for h in x.hits), x["items"]) for x in contamination.match(docs, bench).collect()}
    assert got == {i: slow_match([x for x in items if x[0] is not None], t, 13) for i, t in enumerate(texts)}
    assert contamination.match(docs.limit(0), bench).count() == 0
    assert all(x.hits == [] and x["items"] == [] for x in contamination.match(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("shard,held", [(1 << 20, 1 << 25), (300, 1 << 25), (1, 1)])
def test_match_by_row_with_long_items(spark, monkeypatch, shard, held):
    """Rows of one id or none keep their own hits however many shards there are; a long item is hit across its cuts."""
    monkeypatch.setattr(contamination, "SHARD_BYTES", shard)
    monkeypatch.setattr(contamination, "HELD_BYTES", held)
    r = random.Random(5)
    items = [(i, " ".join(f"w{r.randrange(40)}" for _ in range(n))) for i, n in enumerate([400, 30, 5, 13])] + [(7, "same words")]
    words = items[0][1].split()
    texts = [" ".join(words[k:k + 14]) + " tail" for k in range(0, 386, 9)] + [items[0][1], items[1][1] + " x " + items[3][1], "a same words b", "nothing", None]
    rows = [(r.choice([None, 1, 2]), t) for t in texts]
    found = contamination.match(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((str(x.doc_id), x.n_words, sum(h.end - h.start for h in x.hits), x["items"]) for x in found.collect())
    assert got == sorted((str(i), *slow_match(items, t, 13)) for i, t in rows)


def test_shards_are_bounded(monkeypatch):
    monkeypatch.setattr(contamination, "SHARD_BYTES", 200)
    words = [b"%d" % i for i in range(2000)]
    pieces = list(contamination._cut(words, 13))
    assert all(13 <= len(p.split()) and len(p) <= 200 for p in pieces)
    grams = {tuple(p.split()[k:k + 13]) for p in pieces for k in range(len(p.split()) - 12)}
    assert grams == {tuple(words[k:k + 13]) for k in range(1988)}


def test_items_without_an_id_count_as_in_the_twin(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(15))
    named = " ".join(f"q{i}" for i in range(15))
    items = [(None, passage), (None, "only two"), (3, named), (10, named)]
    docs = [(i, t) for i, t in enumerate([passage + " and more", named, passage + " " + named, "a only two b", "nothing here", None])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    order = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    want = sorted(con.execute(f"SELECT {order} FROM ({catalog.ORACLES['op9_contamination']})").fetchall())
    got = sorted(tuple(x) for x in catalog.QUERIES["op9_contamination"](spark, str(tmp_path)).select(*order.split(", ")).collect())
    assert got == want and [x[5] for x in got] == [True, True, True, True, False, False]
    kept = corpus_pipeline.decontaminated(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {x.doc_id for x in kept.collect()} == {4, 5}
