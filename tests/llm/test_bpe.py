import random

import public_tokenizers
import pytest
import tiktoken

from burdenlens.llm import bpe
from burdenlens.llm.common import utf8
import pyarrow as pa


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def sample():
    rnd = random.Random(1)
    signs = "  \n\t\r\x0b\x1c\x85 　''stmdrevlaAéß0٣½_-.,😀中文́​﻿\x00"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    points = [*range(32, 0xD800), *range(0xE000, 0x110000)]
    texts += ["".join(chr(rnd.choice(points)) for _ in range(20)) for _ in range(3000)]
    texts += ["", " ", "  ", "'s", "x's", " 's", "'", "it's'll 're", "a" * 5000, "ab cd" * 2000]
    return [*texts, "".join(rnd.choice("abcdeéß") for _ in range(20_000))]


def test_same_ids_as_the_library(ranks, encoding):
    merger, texts = bpe.Merger(ranks), sample()
    ids, first = merger.encode(*utf8(pa.array(texts)))
    for text, a, b in zip(texts, first[:-1], first[1:], strict=True):
        assert ids[a:b].tolist() == encoding.encode_ordinary(text), text


def test_a_full_cache_changes_nothing(ranks, encoding, monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE", 10)
    merger = bpe.Merger(ranks)
    for text in sample()[:50]:
        assert merger.encode(*utf8(pa.array([text])))[0].tolist() == encoding.encode_ordinary(text)


def test_round_trip_of_a_frame(spark, ranks, encoding):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (1, "Hello wörld"), (None, "a'll " * 3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "1 AS IDS", "2 AS decoded"
    )
    coded = bpe.decode(bpe.encode(frame, ranks), ranks)
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    for row in coded.collect():
        assert row["ids"] == encoding.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
    assert bpe.decode(bpe.encode(frame.limit(0), ranks), ranks).count() == 0
