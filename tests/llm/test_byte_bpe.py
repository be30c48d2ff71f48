"""Byte-level BPE against the tiktoken library, text by text."""

import hashlib
import random

import llm_cases as cases
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ledgerloom.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library(path=PATH):
    return tiktoken.Encoding("library", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def awkward_texts():
    rnd = random.Random(3)

    def character():
        return chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x80, 0x800), rnd.randrange(0x10000, 0x32000),
                               rnd.choice([9, 10, 32, 32, 39, 115, 0x2003, 0x85, 0x1C, 0x558, 0x10D40, 0x1CCF0])]))

    found = ["".join(character() for _ in range(rnd.randrange(300))) for _ in range(200)]
    return found + [None, "", " " * 5000 + "a", "x" * 60_000, "they're   here's\n\n  <|endoftext|> it's\t\t x", "՘a՘ ՘"]


@pytest.mark.parametrize("path", [PATH, MULTI])
def test_ids_are_those_of_the_library(spark, path):
    rows = list(enumerate(awkward_texts())) + [(1, "again"), (1, "again"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(t, "x", i, 5) for i, t in rows], "text string, ids string, doc_id long, block int").repartition(5)
    encoded = byte_bpe.encode(spark, docs, path, public_tokenizers.PATTERN, shards=7, block_chars=9_000)
    assert encoded.columns == ["doc_id", "tokens"]
    got = cases.counted((r.doc_id, tuple(np.frombuffer(r.tokens, '<u4').tolist()), bytes(r.decoded)) for r in byte_bpe.decode(spark, encoded, path).collect())
    ask = library(path).encode_ordinary
    assert got == cases.counted((i, tuple(ask(t or "")), (t or "").encode()) for i, t in rows)


def test_words_merge_as_in_the_library():
    ranks, rnd, ask = byte_bpe.read_ranks(PATH), random.Random(8), library()
    for n in [1, 2, 3, 5, 9, 30, 200, 3000]:
        for _ in range(60):
            word = "".join(rnd.choices("abeinorstABé", k=n))
            assert byte_bpe.encode_word(word.encode(), ranks) == ask.encode_ordinary(word)


def test_every_character_has_the_class_of_the_library():
    split = byte_bpe.PreTokens(public_tokenizers.PATTERN, byte_bpe.class_differences())
    text, ask, ranks = "", library(), byte_bpe.read_ranks(PATH)
    for c in byte_bpe.class_differences():
        text += f"a{chr(c)}1{chr(c)}! {chr(c)}  "
    assert [i for word in split(text) for i in byte_bpe.encode_word(word.encode(), ranks)] == ask.encode_ordinary(text)


def test_ids_outside_the_vocabulary_are_refused(spark):
    def rows(*tokens):
        return spark.createDataFrame([(None if t is None else np.array(t, "<u4").tobytes(),) for t in tokens], "tokens binary")

    assert {r.decoded and bytes(r.decoded) for r in byte_bpe.decode(spark, rows([64, 65], None, []), PATH).collect()} == {b"ab", None, b""}
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark, rows([50256]), PATH).collect()


def test_blocks_and_words_share_one_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encoded = byte_bpe.encode(spark, docs, PATH, public_tokenizers.PATTERN)
    assert len(encoded.collect()) == docs.count()
    assert encoded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange") == 1


def test_query_gives_the_digests(spark, sf_dir):
    ask, want = library(), []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = ask.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = queries.op13_byte_bpe(spark, sf_dir)
    assert dict(got.dtypes)["n_tokens"] == "bigint"
    assert cases.counted(map(tuple, got.collect())) == cases.counted(want)
