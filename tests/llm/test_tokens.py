"""Packing and token counts against the tokenizer library itself."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from widesift.llm import packing, token_counts, tokens

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = ["Plain words, and more words.", "", None, "  two  blanks\n\n after\tlines \n x ", "'s it's <|endoftext|> in<|endoftext|>side", "é日本 …!? 12 345",
         "x" * 30_000, "word " * 40_000, " " * 5000, "a\x1c b  c​ d\0 e", "Plain words, and more words."]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def frame(spark, texts, parts=3):
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key long, ids string").repartition(parts)


def test_segments_encode_like_whole_texts(library):
    encode = tokens.Encoder(PATH)
    parts = [" ", "  ", "\n", "\t", "\0", "a", "b'", "'s", "1", "é", "\xa0", "　", "\x1c", "<|endoftext|>", "!", "…", " ", "\x85", "​", "ſ"]
    texts = ["".join(random.Random(seed).choices(parts, k=seed % 14)) for seed in range(1500)]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["x", *texts]).slice(1), *(pa.array([t]) for t in texts[:200])):
        segments, by_text = encode._cut(column)
        ids, stops = encode(column)
        assert b"".join(segments.to_pylist()).decode() == "".join(column.to_pylist()) and by_text[-1] == len(segments)
        for text, i, j in zip(column.to_pylist(), stops, stops[1:]):
            assert ids[i:j].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_boundaries_follow_something_other_than_white_space():
    safe = re.compile(f"(?<=[^{re.escape(tokens.SPACES)}])(?=[ \n])")
    for seed in range(500):
        text = "".join(random.Random(seed).choices("ab é\n\t\u3000\u2003\xa0\x85\ufeffß€😀", k=40))
        want = [len(text[:m.start()].encode()) for m in safe.finditer(text)]
        assert tokens.boundaries(np.frombuffer(text.encode(), np.uint8)).tolist() == want


def test_what_is_forgotten_is_encoded_again(library, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 20)
    encode = tokens.Encoder(PATH)
    for seed in range(60):
        text = " ".join(random.Random(seed).choices(["alpha", "beta", "q" * 100, "r" * 70, "gamma"], k=30)) + f" word{seed}"
        ids, _ = encode(pa.array([text, "", text]))
        assert ids.tolist() == 2 * library.encode(text, add_special_tokens=False).ids


def test_token_counts(spark, library):
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, TEXTS), PATH, limit=1024).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 1024)


def test_token_counts_keep_repeated_rows_and_empty_tables(spark):
    docs = frame(spark, ["one two", "one two"])
    assert token_counts.count_tokens(docs.unionByName(docs), PATH).count() == 4
    empty = token_counts.count_tokens(docs.limit(0), PATH)
    assert empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and empty.count() == 0


def check_packing(rows, texts, library, capacity):
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.doc_tokens == len(ids[r.doc_id])
        assert list(struct.unpack(f"<{r.length}I", r.ids)) == ids[r.doc_id][r.start:r.start + r.length]
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at and length > 0
            at += length
        assert at == len(own)
    sizes = Counter()
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        sizes[at] += 1
    return sizes


def test_packing_places_every_id_once(spark, library):
    texts = TEXTS + [" ".join(random.Random(i).choices(["alpha", "beta", "gamma", "delta"], k=i * 7 % 900)) for i in range(300)]
    rows = packing.pack(frame(spark, texts, 4), PATH).collect()
    sizes = check_packing(rows, texts, library, 2048)
    assert all(n & (n - 1) == 0 for n in sizes)  # no sequence needs padding
    assert sum(c for n, c in sizes.items() if n < 2048) <= 4 * 11
    crc = packing.pack(frame(spark, ["one"], 1), PATH).select(F.crc32("ids").alias("c"), "ids").first()
    assert crc.c == zlib.crc32(bytes(crc.ids))


def test_packing_in_small_pools(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "POOL_IDS", 500)
    texts = [" ".join(["w"] * (i * 13 % 90)) for i in range(200)]
    check_packing(packing.pack(frame(spark, texts, 2), PATH, capacity=64).collect(), texts, library, 64)


def test_packing_of_an_empty_table(spark):
    assert packing.pack(frame(spark, ["x"]).limit(0), PATH).count() == 0


def test_best_fill_is_optimal():
    for seed in range(300):
        r = random.Random(seed)
        room = r.randint(1, 40)
        counts = [0] * 50
        for _ in range(r.randint(0, 5)):
            counts[r.randint(1, 45)] += r.randint(1, 3)
        reach = {0}
        for n, c in enumerate(counts):
            for _ in range(c):
                reach |= {x + n for x in reach if x + n <= room}
        used = packing.best_fill(counts, room)
        assert sum(n * c for n, c in used.items()) == max(reach) and all(c <= counts[n] for n, c in used.items())
