"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Texts are exploded into pre-tokens with their positions, one block of neighbouring
documents at a time: a block keeps its pre-tokens in order as numbers of its own distinct
words. The distinct words of all blocks meet in shards by their hash, where each distinct word is
encoded once. The ids are joined back to the blocks that asked for the word, and the block puts
its documents together again by position. Decoding joins every id with the token-byte table.

A block holds one row for each of its words and shards, never one row for each occurrence, so a
word that fills a third of all texts costs a shard no more than any other word of the blocks it is in.
The rows between blocks and shards are packed; written out as one row for each word they
are three times as many bytes.

Only the rank table is sent to every task. It is as long as the vocabulary file, whatever the
corpus. A task holds one block (``BLOCK_CHARS``, or one longer text) or the distinct words of one shard.

Defined results: null text is empty and has no ids; rows with the same id are separate rows; an
empty table gives no rows; ids outside the vocabulary, when decoded, raise an error. Only the id and text
columns are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import heapq
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

# Workers receive these functions themselves, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_CHARS = 4_000_000  # pre-tokens of so many characters share one block
SHARDS = 256  # into which distinct words are dealt; a task holds the words of one

# A character of each class of a pre-token pattern; none has a part in contractions or is the plain blank.
_LETTER, _NUMBER, _BLANK, _OTHER = "\u00aa", "\u00b2", "\u2003", "\ue000"


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank table: a token's bytes and its id, from lines of base64 and a number."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


@cache
def class_differences() -> dict[int, str]:
    """Characters that the tiktoken library and this one's matcher put in different classes.

    The two follow different versions of Unicode. Each such character gets a stand-in
    of the class that the tiktoken library gives it.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single_bytes = {bytes([i]): i for i in range(256)}
    differing: dict[str, set[str]] = {}
    theirs: dict[str, set[str]] = {}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        encoding = tiktoken.Encoding("one class", pat_str=kind, mergeable_ranks=single_bytes, special_tokens={})
        theirs[kind] = set(bytes(encoding.encode_ordinary(every)).decode())
        differing[kind] = theirs[kind].symmetric_difference(regex.findall(kind, every))
    return {ord(c): next((stand_in for kind, stand_in in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _BLANK))
                          if c in theirs[kind]), _OTHER) for c in set().union(*differing.values())}


class PreTokens:
    """Splits texts as the pattern does under the tiktoken library's classes of characters."""

    def __init__(self, pattern: str, stand_ins: dict[int, str]):
        self.matcher = regex.compile(pattern)
        self.stand_ins = stand_ins
        self.first = chr(min(stand_ins, default=0x10FFFF))

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or max(text) < self.first:
            return self.matcher.findall(text)
        return [text[m.start():m.end()] for m in self.matcher.finditer(text.translate(self.stand_ins))]


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the neighbours of lowest rank, leftmost first, until none can be merged."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    stop, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place
    open_pairs = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(open_pairs)
    wanted: dict[int, int] = {i: r for r, i in open_pairs}

    def look(start: int) -> None:
        middle = stop[start]
        rank = ranks.get(word[start:stop[middle]]) if middle < n else None
        if rank is None:
            wanted.pop(start, None)
        else:
            wanted[start] = rank
            heapq.heappush(open_pairs, (rank, start))

    while open_pairs:
        rank, start = heapq.heappop(open_pairs)
        if wanted.get(start) != rank:
            continue
        middle = stop[start]
        wanted.pop(middle, None)
        stop[start] = end = stop[middle]
        if end < n:
            before[end] = start
        look(start)
        if before[start] >= 0:
            look(before[start])
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at:stop[at]]])
        at = stop[at]
    return ids


def _packed(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(
        np.array([len(p) for p in parts], dtype="<u8").tobytes() + b"".join(parts))


def _unpacked(data: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = 8 * n + np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u8", n))]).astype(int)
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers with all their lowest bytes together, then all second ones: high bytes repeat and pack well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _joined(pieces: list[bytes]) -> tuple[bytes, bytes]:
    return np.array([len(p) for p in pieces], dtype="<u4").tobytes(), b"".join(pieces)


def _cut(lengths: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(lengths, "<u4")).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class _Block:
    """The documents read since the last block, as numbers of their distinct words."""

    def __init__(self):
        self.numbers: dict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.docs, self.counts, self.places, self.chars = [], [], [], 0

    def add(self, doc, text: str, pieces: list[str]) -> None:
        self.docs.append(doc)
        self.counts.append(len(pieces))
        self.places.append(np.fromiter(map(self.numbers.__getitem__, pieces), "<u4", len(pieces)))
        self.chars += len(text)

    def rows(self, block: int, shards: int) -> list[dict]:
        """One row for the block itself, and one for each shard that it asks."""
        places = np.concatenate(self.places)
        common_first = np.argsort(-np.bincount(places, minlength=len(self.numbers)), kind="stable")
        new_number = np.empty(len(common_first), dtype="<u4")
        new_number[common_first] = np.arange(len(common_first))
        by_number = list(self.numbers)
        words = [by_number[i].encode() for i in common_first]
        shard_of = np.fromiter((zlib.crc32(w) % shards for w in words), "<u4", len(words))
        order = np.argsort(shard_of, kind="stable")
        cuts = np.searchsorted(shard_of[order], np.arange(shards + 1))
        asked = [(s, _joined([words[i] for i in order[cuts[s]:cuts[s + 1]]])) for s in range(shards) if cuts[s] < cuts[s + 1]]
        checks = np.array([_check(*of_shard) for _, of_shard in asked], dtype="<u4").tobytes()
        own = {"route": block, "block": block, "shard": None, "docs": self.docs, "counts": self.counts,
               "data": _packed(_planes(new_number[places]), _planes(shard_of), checks)}
        return [own] + [{"route": -1 - s, "block": block, "shard": s, "docs": None, "counts": None,
                         "data": _packed(*of_shard)} for s, of_shard in asked]


def _check(lengths: bytes, words: bytes) -> int:
    return zlib.crc32(words, zlib.crc32(lengths))


def _blocks(split: PreTokens, schema: pa.Schema, shards: int, block_chars: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The same rows, read again by another attempt of the task, get the same blocks with the same numbers.
        number = TaskContext.get().partitionId() << 32
        block = _Block()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                block.add(doc, text, split(text))
                if block.chars >= block_chars:
                    yield pa.RecordBatch.from_pylist(block.rows(number, shards), schema)
                    block, number = _Block(), number + 1
        if block.docs:
            yield pa.RecordBatch.from_pylist(block.rows(number, shards), schema)

    return blocks


def _answers(ranks, schema: pa.Schema):
    """Each distinct word of a shard is encoded once; the rows of a shard come one after another."""

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shard, known = ranks.value, None, {}
        for batch in batches:
            found = []
            for block, of_shard, data in zip(*(batch.column(c).to_pylist() for c in ("block", "shard", "data"))):
                if of_shard != shard:
                    shard, known = of_shard, {}
                lists, asked = [], _unpacked(data, 2)
                for word in _cut(*asked):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(encode_word(word, table), dtype="<u4").tobytes()
                    lists.append(ids)
                lengths, ids = _joined(lists)
                found.append({"block": block, "shard": shard, "check": _check(*asked),
                              "ids": _packed(lengths, _planes(np.frombuffer(ids, "<u4")))})
            yield pa.RecordBatch.from_pylist(found, schema)

    return answers


def _reassembled(schema: pa.Schema):
    """Put the ids of a block's words where the words stood, document by document."""

    def reassembled(block: pa.Table, answered: pa.Table) -> pa.Table:
        rows = block.select(["docs", "counts", "data"]).to_pylist()
        if not rows or rows[0]["docs"] is None:  # what shards were asked
            return schema.empty_table()
        row, = rows
        raw, shards, checks = _unpacked(row["data"], 3)
        places, shard_of = _from_planes(raw), _from_planes(shards)
        lengths = np.zeros(len(shard_of), dtype=np.int32)
        starts = np.zeros(len(shard_of), dtype=np.int64)
        ids, at = [], 0
        order = np.argsort(shard_of, kind="stable")
        asked, first = np.unique(shard_of[order], return_index=True)
        cuts, check_of = dict(zip(asked, first)), dict(zip(asked, np.frombuffer(checks, "<u4")))
        answers = answered.to_pylist()
        if {a["shard"]: a["check"] for a in answers} != check_of:
            raise RuntimeError("the texts came in another order when a task was run again; write them to a table first")
        for answer in answers:
            n_ids, planes = _unpacked(answer["ids"], 2)
            n_ids = np.frombuffer(n_ids, "<u4").astype(np.int64) // 4
            mine = order[cuts[answer["shard"]]:][:len(n_ids)]
            lengths[mine] = n_ids
            starts[mine] = at + np.cumsum(n_ids) - n_ids
            ids.append(_from_planes(planes))
            at += len(ids[-1])
        every = np.concatenate([*ids, np.zeros(0, "<u4")])
        count = lengths[places]
        stop = np.cumsum(count, dtype=np.int64)
        # The token at a place of the block is as far from its word's first token here as there.
        where = np.repeat(starts[places] - (stop - count), count)
        where += np.arange(len(where))
        tokens = every[where].tobytes()
        ends = 4 * np.concatenate([[0], stop])[np.cumsum(row["counts"])]
        return pa.table([pa.array(row["docs"], schema.field(0).type),
                         pa.array([tokens[a:b] for a, b in zip([0, *ends], ends)], schema.field(1).type)], schema=schema)

    return reassembled


def encode(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id",
           text_col: str = "text", shards: int = SHARDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: its id and its tokens, the ids in order as little-endian unsigned 32-bit integers.

    The texts should come from a table, so that a task that is run again reads the same rows; otherwise that is noticed
    and the job fails.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    doc_type = texts.schema["doc_id"].dataType
    dealt_type = StructType([
        StructField("route", LongType()), StructField("block", LongType()), StructField("shard", IntegerType()),
        StructField("docs", ArrayType(doc_type)), StructField("counts", ArrayType(LongType())), StructField("data", BinaryType())])
    split = PreTokens(pattern, class_differences())
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    # Blocks and what they ask go through one shuffle, which both branches below read.
    dealt = texts.mapInArrow(_blocks(split, to_arrow_schema(dealt_type), shards, block_chars), dealt_type).repartition("route")
    # A plain condition would be moved before the shuffle, which could then not be shared.
    asked = F.when(F.spark_partition_id() >= 0, F.col("shard").isNotNull())
    answer_type = StructType([StructField("block", LongType()), StructField("shard", IntegerType()),
                              StructField("check", LongType()), StructField("ids", BinaryType())])
    answers = dealt.filter(asked).sortWithinPartitions("route").mapInArrow(_answers(ranks, to_arrow_schema(answer_type)), answer_type)
    encoded_type = StructType([StructField("doc_id", doc_type), StructField("tokens", BinaryType())])
    return dealt.groupBy("route").cogroup(answers.groupBy("block")).applyInArrow(
        _reassembled(to_arrow_schema(encoded_type)), encoded_type)


def decode(spark: SparkSession, encoded: DataFrame, ranks_path: str, *, tokens_col: str = "tokens",
           bytes_col: str = "decoded") -> DataFrame:
    """Add the bytes that the tokens of each row stand for; null tokens give null."""
    ranks = read_ranks(ranks_path)
    by_id: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    table = spark.sparkContext.broadcast(by_id)
    out = StructType([*encoded.schema.fields, StructField(bytes_col, BinaryType())])
    tokens_at, schema = encoded.columns.index(tokens_col), to_arrow_schema(out)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bytes = pa.array(table.value, pa.large_binary())

        def joined(tokens: bytes | None) -> bytes | None:
            if tokens is None:
                return None
            ids = np.frombuffer(tokens, "<u4")
            found = token_bytes.take(pa.array(ids[ids < len(token_bytes)]))
            if len(found) < len(ids) or found.null_count:
                raise ValueError("an id is not in the vocabulary")
            ends = np.frombuffer(found.buffers()[1], np.int64)
            return bytes(memoryview(found.buffers()[2] or b"")[ends[0]:ends[len(ids)]]) if len(ids) else b""

        for batch in batches:
            texts = [joined(t.as_py()) for t in batch.column(tokens_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, schema.field(-1).type)], schema=schema)

    return encoded.mapInArrow(decoded, out)


def count_tokens(tokens: str) -> Column:
    return (F.octet_length(tokens) / 4).cast("long")
