"""Packing by power-of-two decomposition: every document is cut into pieces of binary lengths.

A document's ids, with the end id behind them, are cut from the front into pieces of 2048 and then into
the powers of two that make up what is left, largest first. Pieces of equal length share a bucket, a
sequence is one piece, so no sequence crosses documents and none is padded. Batches of equal length are
then read from one bucket, which ``bucket`` (the exponent) names; write with ``partitionBy("bucket")``.

Each task numbers its own sequences, so nothing is shuffled and no count passes through the driver.

Defined results: null and empty texts give one piece, the end id; repeated rows are packed once each;
sequence_id is unique over all rows, also when ids are null or repeated. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenfiles
from .common import nullable_text, ship

LENGTH, END_ID = 2048, 1
#: The pre-token pattern of the byte-level vocabulary, a fixed value of that format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Its special string, which texts may hold and which is then this one id.
SPECIALS = (("<|endoftext|>", 50256),)


def cut(n: int, longest: int = LENGTH) -> list[int]:
    """Lengths of the pieces of n ids: ``longest`` (a power of two) as often as it goes, then falling powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pack(file: str, longest: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, names = tokenfiles.rank_encoding(file, PATTERN, SPECIALS), {s for s, _ in SPECIALS}
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(texts), 1000):
                out: list[tuple] = []
                for doc_id, text in zip(ids[at : at + 1000], texts.slice(at, 1000).to_pylist()):
                    tokens = np.append(encoding.encode_to_numpy(text, allowed_special=names), np.uint32(END_ID)).astype("<u4")
                    raw, start = tokens.tobytes(), 0
                    for length in cut(len(tokens), longest):
                        piece = raw[4 * start : 4 * (start + length)]
                        out.append((doc_id, start, length, zlib.crc32(piece), len(tokens), length.bit_length() - 1, *([tokens[start : start + length].astype(np.int64)] if with_ids else [])))
                        start += length
                kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.list_(pa.int64())] * with_ids
                names_ = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", *["ids"] * with_ids]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names_)

    return run


def pack(docs: DataFrame, longest: int = LENGTH, with_ids: bool = False, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, and ids if asked for."""
    if longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), nullable_text().alias("text"))
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<long>" * with_ids
    pieces = rows.mapInArrow(_pack(tokenfiles.path(vocabulary, folder), longest, with_ids), kinds)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", *["ids"] * with_ids)
