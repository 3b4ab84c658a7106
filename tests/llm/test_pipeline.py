"""The pipeline against plain Python on a small corpus, stage by stage."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_models import slow_match
from tests.llm.test_native import slow_secrets
from tests.llm.test_pairs import sets, slow_print
from tests.llm.test_tokens import check_packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    r = random.Random(0)
    english, german = "the of and with from this that word house".split(), "der die und nicht mit von haus wort auch".split()
    words = lambda pool, n: " ".join(r.choice(pool) + r.choice(["", "ing", "er"]) for _ in range(n))
    items = [(i, words(english, 20)) for i in range(5)]
    texts = [(words(pool, 120), lang) for pool, lang in ((english, "en"), (german, "de")) for _ in range(30)]
    texts += [(texts[3][0], "en"), (texts[3][0], "en"), (texts[7][0] + " more", "en"), (None, None), ("", "en"), ("123 %%", "de"),
              (words(english, 50) + " " + items[2][1] + " " + words(english, 50), "en"), ("token = abcdefghij " + words(english, 90), "en"), (words(german, 9), None)]
    rows = [(i, t, lang, "s", len(t) if t else 0) for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {x[0]: x for x in rows}, items


def test_pipeline(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.dtypes == spark.createDataFrame([], SCHEMA).dtypes
        steps.append({x.doc_id: tuple(x) for x in docs.collect()})
    letters = {i for i, x in rows.items() if x[1] and any(c.isalpha() for c in x[1])}
    assert steps[0] == {i: rows[i] for i in letters}
    prints = {i: slow_print(rows[i][1]) for i in letters}
    groups = sets([(i, j) for i in letters for j in letters if j < i and (prints[i] ^ prints[j]).bit_count() <= 3], letters)
    assert set(steps[1]) == set(groups.values()) and len(steps[1]) < len(steps[0])
    n = {i: slow_match(items, x[1], 13) for i, x in steps[1].items()}
    assert set(steps[2]) == {i for i, (words, hit, _) in n.items() if not (hit and 20 * hit >= words)} and len(steps[2]) < len(steps[1])
    assert set(steps[3]) == set(steps[2])
    for i, x in steps[3].items():
        assert slow_secrets(x[1]) == "" and x[4] == len(x[1])
        assert (x == steps[2][i]) == (slow_secrets(steps[2][i][1]) == "")
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    order = sorted(steps[3])
    pieces = corpus_pipeline.run(spark, folder).collect()
    at = {i: k for k, i in enumerate(order)}
    check_packing([Renamed(p, at[p.doc_id]) for p in pieces], [steps[3][i][1] for i in order], library, 2048)


class Renamed:
    def __init__(self, row, doc_id):
        self.__dict__.update(row.asDict(), doc_id=doc_id)


def test_stages_with_nulls_repeated_rows_and_no_rows(spark, corpus):
    folder, _, _ = corpus
    docs = spark.createDataFrame([(1, "the and of", None, None, None), (1, "the and of", None, None, None), (None, "the of and with", "en", None, 3),
                                  (2, None, None, None, None)], SCHEMA)
    kept = {name: stage(spark, docs, folder).count() for name, stage in corpus_pipeline.STAGES[1:4]}
    assert kept == {"SimHash near-dedup": 3, "benchmark decontamination": 4, "secret scans": 4}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.known_language(spark, docs, folder).count() <= 4


def test_stages_decide_by_row(spark, corpus):
    """Rows without an id are rejected like any other, and no row goes with another one of its id."""
    folder, rows, items = corpus
    clean, other, copied, hit = rows[3][1], rows[5][1], rows[40][1], items[2][1]
    row = lambda i, text: (i, text, "en", "s", len(text))
    docs = spark.createDataFrame([row(i, rows[i][1]) for i in range(10, 20)] + [
        row(3, clean), row(10, clean), row(None, clean), row(None, copied), row(None, copied), row(8, "123 %%"), row(8, other), row(None, "456 %%"),
        row(9, hit), row(9, other + " x"), row(None, hit)], SCHEMA).repartition(3)
    out = lambda stage: sorted(((x.doc_id, x.text) for x in stage(spark, docs, folder).collect()), key=str)
    every = [(x.doc_id, x.text) for x in docs.collect()]
    assert out(corpus_pipeline.known_language) == sorted((x for x in every if "%%" not in x[1]), key=str)
    assert out(corpus_pipeline.decontaminated) == sorted((x for x in every if x[1] != hit), key=str)
    texts = {t: slow_print(t) for _, t in every}
    groups = sets([(a, b) for a in texts for b in texts if (texts[a] ^ texts[b]).bit_count() <= 3], list(texts))
    best = {}
    for i, text in every:
        best[groups[text]] = min(best.get(groups[text], (True, 0, "")), (i is None, i or 0, text))
    got = out(corpus_pipeline.near_dedup)
    assert len(got) == len(best) and {(i, groups[t]) for i, t in got} == {(None if none else i, g) for g, (none, i, _) in best.items()}
    assert (10, rows[10][1]) in got and (3, clean) in got and (10, clean) not in got and sum(t == copied for _, t in got) == 1
