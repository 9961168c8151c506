import random

import pytest

from palimpsest.llm import tokencount

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES = tokencount.default_tokenizer()


def library(path, text):
    if path.endswith(".model"):
        return len(tokencount._pieces_model(path).encode(text))
    return len(tokencount._library(path).encode(text, add_special_tokens=False).ids)


def test_proof_holds_for_each_string(spark):
    proven = {r["id"]: r["token"] for r in tokencount.whole_tokens(spark, BYTES).collect()}
    tokenizer = tokencount._library(BYTES)
    assert len(proven) > 50_000 and 50256 not in proven
    for k in random.Random(3).sample(sorted(proven), 2000):
        text = tokenizer.decode([k])
        if "�" not in text:  # whole signs
            assert len(tokenizer.pre_tokenizer.pre_tokenize_str(text)) > 1 or tokenizer.encode(text, add_special_tokens=False).ids == [k]


def test_counts_equal_the_library_on_odd_texts(spark):
    whole = frozenset(r["token"] for r in tokencount.whole_tokens(spark, BYTES).collect())
    count = tokencount.counter(BYTES, whole)
    rng = random.Random(11)
    signs = list("ab AB12\t\n\r\x0b\x0c\x1c\x1f\x85\xa0'sd.,;:!?-_()<|>\x00\x7f") + [
        " ", "᠎", " ", "​", " ", "　", "﻿", "é", "中", "Ж", "½", "Ⅷ", "\U0001f600", "́", "٣",
        "<|endoftext|>", "  ", "   ", "'ll", "'re", " \n", "the", " of",
    ]
    for _ in range(5000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        assert count(text) == library(BYTES, text), repr(text)


def test_all_documents(spark, sf):
    from palimpsest.llm.registry import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_token_count"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = library(BYTES, texts[r["doc_id"]])
        assert tuple(r) == (r["doc_id"], len(texts[r["doc_id"]].encode()), n, n > 512)


def test_few_pretokens_are_merged(spark, sf):
    whole = frozenset(r["token"] for r in tokencount.whole_tokens(spark, BYTES).collect())
    count = tokencount.counter(BYTES, whole)
    text = "the of and to in that it was for on are with as his they at be this from have " * 50
    assert count(text) == library(BYTES, text) and count.merged == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_get_whole_texts(spark, name):
    path = public_tokenizers.path(name)
    texts = ["", "The cat  sat.\n\n", "Été <|endoftext|> 中文", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs, tokenizer=path).collect()} == {k: library(path, t or "") for k, t in enumerate(texts)}


def test_odd_rows(spark, monkeypatch):
    long = "x" * 50_000 + " word" * 20_000
    rows = [(1, None, 7, True), (None, "a b", 8, True), (2, "", None, False), (2, "", None, False), (3, long, 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, over_limit boolean")
    got = sorted((tuple(r) for r in tokencount.count_tokens(docs, limit=1, keep=("n_tokens", "over_limit")).collect()), key=str)
    want = [(i, (n, o), len((t or "").encode()), library(BYTES, t or ""), library(BYTES, t or "") > 1) for i, t, n, o in rows]
    assert [(a, tuple(k), *rest) for a, k, *rest in got] == sorted(want, key=str)
    assert tokencount.count_tokens(docs.limit(0)).collect() == []
    monkeypatch.setattr(tokencount, "REMEMBERED", 3)  # what is forgotten is counted again
    assert tokencount.counter(BYTES)(long) == library(BYTES, long)
