"""Token ids as coded blocks: written in ascending doc_id order, read back, digested.

Documents are dealt by range of doc_id; each part sorts its rows, tokenises them and codes their
ids in blocks of whole documents (see rangecoder). A block stands in a row of a table in the
shared folder, so it lies in whatever store Spark writes to; besides the coded ids it holds the
doc_ids and lengths of its documents and the ids before it in its part. Reading decodes
and checks every block; ids before a part are the sums of the parts before it, of
which there is one number for each.

Defined results: null or empty text: the end id alone; null doc_id: first; equal doc_ids: by
XXH64 of the text, then text; repeated rows: each by itself; a text longer than a block: a block by itself; an empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rangecoder
from .common import column_of, shuffle_parts, stash, table
from .tokens import encoder, tokenizer_path

NAME = "op6_token_ids"
SQL = None
BLOCKS = "part int, block int, n_ids long, payload binary"
_HEAD = struct.Struct("<4sQII")
_FILE = b"BID1"
_NO_ID = -(1 << 63)


def to_block(doc_ids: list, lengths: list[int], ids: np.ndarray, before: int, alphabet: int) -> bytes:
    """One block of the file format: header, doc_ids and lengths (deflated), coded ids."""
    held = np.array([_NO_ID if d is None else d for d in doc_ids], dtype="<i8").tobytes() + np.array(lengths, dtype="<i8").tobytes()
    docs = zlib.compress(held, 6)
    return _HEAD.pack(_FILE, before, len(doc_ids), len(docs)) + struct.pack("<I", zlib.crc32(held)) + docs + rangecoder.encode(ids, alphabet)


def from_block(raw: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    """doc_ids, lengths, ids, ids before the block in its part; ValueError if damaged."""
    if len(raw) < _HEAD.size + 4:
        raise ValueError("block cut short")
    magic, before, n, size = _HEAD.unpack_from(raw)
    at = _HEAD.size + 4
    try:
        held = zlib.decompress(raw[at : at + size])
    except zlib.error as e:
        raise ValueError("block damaged") from e
    if magic != _FILE or struct.unpack_from("<I", raw, _HEAD.size)[0] != zlib.crc32(held):
        raise ValueError("block damaged")
    doc_ids = [None if d == _NO_ID else d for d in np.frombuffer(held, dtype="<i8", count=n).tolist()]
    lengths = np.frombuffer(held, dtype="<i8", offset=8 * n).astype(np.int64)
    return doc_ids, lengths, rangecoder.decode(raw[at + size :]), before


def write_ids(docs: DataFrame, path: str | None = None, end_id: int = 2, alphabet: int = 49408, parts: int | None = None) -> DataFrame:
    """The written table of blocks."""
    parts = parts or shuffle_parts(docs.sparkSession)

    def blocks(batches):
        encode = encoder(path or tokenizer_path("word_bpe_49k.json"), "word", end_id).encode
        part, number, before = TaskContext.get().partitionId(), 0, 0
        held: tuple[list, list, list] = ([], [], [])
        size = 0

        def close():
            raw = to_block(held[0], held[1], np.frombuffer(b"".join(held[2]), dtype="<u4"), before, alphabet)
            for x in held:
                x.clear()
            cols = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([raw], pa.binary())]
            return pa.record_batch(cols, ["part", "block", "n_ids", "payload"])

        for batch in batches:
            for doc_id, ids in zip(column_of(batch, "doc_id"), encode(column_of(batch, "text"))):
                n = len(ids) // 4
                if size and size + n > rangecoder.BLOCK_IDS:
                    yield close()
                    number, before, size = number + 1, before + size, 0
                for x, v in zip(held, (doc_id, n, ids)):
                    x.append(v)
                size += n
        if size:
            yield close()

    # a hash of the text stands second in the order, so that rows of one id, or of none, are cut into ranges too
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc(), F.col("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"))
    rows = rows.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    return stash(rows.mapInArrow(blocks, BLOCKS), "token-ids")


def read_ids(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the written blocks."""
    sums = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    starts, total = [], 0  # one number for each part
    for part in range(max(sums, default=-1) + 1):
        starts.append(total)
        total += sums.get(part, 0)

    def digests(batches):
        for batch in batches:
            for part, raw in zip(column_of(batch, "part"), batch.column(batch.schema.get_field_index("payload"))):
                doc_ids, lengths, ids, before = from_block(raw.as_py())
                ends = np.cumsum(lengths)
                data = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(ends - lengths + before + starts[part]), pa.array(lengths), pa.array(crcs, pa.int64())]
                yield pa.record_batch(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "payload").mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all texts as coded ids of the word vocabulary, digested from the blocks read back."""
    return read_ids(write_ids(table(spark, sf_dir, "documents")))
