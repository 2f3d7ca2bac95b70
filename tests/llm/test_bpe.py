import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe
from tests.conftest import SF_SMALL

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = regex.compile(public_tokenizers.PATTERN)
EXACT = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def split(texts):
    _, start, end, doc = bpe.pre_tokens(texts)
    joined, out = "\n".join(texts) + "\n", [[] for _ in texts]
    for a, b, d in zip(start.tolist(), end.tolist(), doc.tolist()):
        out[d].append(joined[a:b])
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'srelvdmtN 9é1²½!.…字ü\t\n\r\x0b\x1c\x85\xa0 \x00", max_size=25), min_size=1, max_size=6))
def test_pre_tokens_equal_the_pattern(texts):
    assert split(texts) == [PATTERN.findall(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)))
def test_words_equal_the_library(text):
    got = [i for w in split([text])[0] for i in bpe.merge(w.encode(), RANKS)]
    assert got == EXACT.encode_ordinary(text)


@pytest.mark.parametrize("word", ["a" * 1500, "ab" * 900, "the" * 400 + "x"])
def test_long_words(word):
    assert bpe.merge(word.encode(), RANKS) == EXACT.encode_ordinary(word)


def test_cases_round_trip(spark, make):
    random.seed(5)
    rows = [(1, None), (2, ""), (3, "hello world's  end \n\n"), (3, "hello world's  end \n\n"), (None, "no id"), (4, " "),
            (5, "x" * 50_000 + " " + "word " * 20_000), (6, "naïve 字 🙂 don't'll")]
    df = make(rows).withColumnRenamed("lang", "block").withColumnRenamed("source", "ids_")
    got = bpe.decode(bpe.encode(df, RANKS, keep=["doc_id", "block"], buckets=5), RANKS).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), tuple(EXACT.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert sorted((str(r["doc_id"]), tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert {r["block"] for r in got} == {"en"}


def test_several_blocks(make, monkeypatch):
    texts = [(i, " ".join(random.Random(i).choices(["alpha", "beta", "Gamma's", "42", "!!"], k=30))) for i in range(60)]
    from tessera.llm.bpe import Block
    block = Block([t for _, t in texts])
    words = block.words()
    at = 0
    for (_, t), n in zip(texts, block.lengths.tolist()):
        assert b"".join(words[k] for k in block.numbers[at:at + n].tolist()).decode() == t
        at += n


def test_empty_table(empty):
    assert bpe.encode(empty, RANKS).collect() == []


def test_query_equals_the_library(spark):
    from tessera.llm.catalog import QUERIES
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = QUERIES["op6_byte_bpe"](spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = EXACT.encode_ordinary(docs[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()
