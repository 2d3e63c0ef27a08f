import random

import numpy as np
import pytest
from pyspark.sql import functions as F

tokens = pytest.importorskip("waymark.llm.tokens")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def bpe():
    return tokens.load(tokens.default_vocabulary())


@pytest.fixture(scope="module")
def reference():
    library = pytest.importorskip("tokenizers")
    t = library.Tokenizer.from_file(tokens.default_vocabulary())
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def texts():
    draw = random.Random(1)
    some = ["".join(draw.choice("aaabbeethhinng \n\t'.,é日😀x1239ſßĲ ") for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    words = "The working group on tuition fees met 53 times, and agreed nothing. Änderungsantrag zum Thema Bewässerung; señorías don't re-encode".split(" ")
    some += [" ".join(draw.choice(words) for _ in range(30)) for _ in range(300)]
    return [*some, "", " ", "<|endoftext|>", "a" * 50_000, " " * 3000, "ab" * 20_000, "\x00\x01\x7f", "é", "​", "﻿x"]


def test_same_ids_as_the_library(bpe, reference):
    sample = texts()
    assert list(tokens.Encoder(bpe).encode(sample)) == reference(sample)


def test_compatible_pairs_are_those_that_merging_leaves(bpe):
    draw = np.random.default_rng(2)
    spelled = {i: s for s, i in bpe.by_bytes.items()}
    ids = np.array(sorted(spelled))
    a, b = draw.choice(ids[:3000], 4000), draw.choice(ids[:3000], 4000)
    want = [bpe.merge_exactly(spelled[x] + spelled[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert bpe.compatible(a, b).tolist() == want and 0.1 < np.mean(want) < 0.999


def test_words_beyond_the_memory(bpe, reference, monkeypatch):
    monkeypatch.setattr(tokens, "_KEPT_WORDS", 20)
    sample = texts()[:600]
    assert list(tokens.Encoder(bpe).encode(sample)) == reference(sample)


def test_columns(spark, reference):
    df = spark.createDataFrame([(1, "tuition fees", "x"), (2, "", "x"), (3, None, "x"), (1, "tuition fees", None)], "doc_id long, text string, ids string")
    got = df.select("doc_id", tokens.token_ids(spark, F.col("text")).alias("ids"), tokens.token_count(spark, F.col("text")).alias("n")).collect()
    one = reference(["tuition fees"])[0]
    assert [(r.doc_id, r.ids, r.n) for r in got] == [(1, one, len(one)), (2, [], 0), (3, [], 0), (1, one, len(one))]
    assert df.where("false").select(tokens.token_ids(spark, F.col("text"))).count() == 0
