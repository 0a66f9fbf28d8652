"""Packing of tokenised documents into fixed-length sequences by the sum-of-squares rule."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, settled
from .tokenization import WordPieces, encoder, in_parts

CAPACITY = 2048
#: Pieces that one task packs on average.
GROUP_PIECES = 4096


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, all at most ``capacity``.

    Lengths are placed from the longest down. Each goes into the open bin whose use makes the sum, over residual gaps,
    of the squared number of open bins with that gap smallest (the smallest gap among equals); a bin is opened only
    where no open one fits. A length of 0 takes no room and joins the first bin. The work is lengths times capacity,
    in numpy, whatever the number of bins.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_at = np.zeros(capacity + 1, np.int64)  # open bins by what they hold
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    for i in order:
        size = int(lengths[i])
        if size == 0:
            opened = max(opened, 1)
            continue
        level = 0
        if size < capacity:
            there = open_at[1 : capacity - size + 1]
            levels = np.flatnonzero(there)
            if len(levels):
                change = 2 * (open_at[levels + 1 + size] - there[levels]) + 2
                if levels[-1] + 1 + size == capacity:
                    change[-1] = 1 - 2 * there[levels[-1]]  # a full bin is no longer open
                level = int(levels[len(levels) - 1 - int(np.argmin(change[::-1]))]) + 1
        if level:
            chosen = held[level].pop()
            open_at[level] -= 1
        else:
            chosen, opened = opened, opened + 1
        bins[i], offsets[i] = chosen, level
        if level + size < capacity:
            held[level + size].append(chosen)
            open_at[level + size] += 1
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids and ``end_id``, cut at every ``capacity`` tokens.

    A null text counts as empty and still has its end id; repeated rows give repeated pieces. Texts don't move.
    """
    last = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, WordPieces).encode
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for begin, end in in_parts(texts):
                rows, pieces, starts, lengths, sums = [], [], [], [], []
                for row, ids in enumerate(encode(texts[begin:end]), begin):
                    ids += last
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append(row)
                        pieces.append(piece)
                        starts.append(at // 4)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """All columns of ``pieces`` (which has a ``length``), and sequence_id and offset.

    Full pieces are sequences of their own. The rest is dealt by a hash of its columns into groups of like size
    distribution, about ``group_pieces`` each, and each group is packed by ``sum_of_squares`` in one task: bounded work
    a task, and a group's few part-filled sequences are all that splitting costs. Rows move once, without texts.
    """
    with arrow_batches(pieces.sparkSession, 1000):
        pieces = settled(pieces)
    names = pieces.columns
    rest = pieces.filter(F.col("length") < capacity)
    groups = max(1, math.ceil(rest.count() / group_pieces))
    dealt = pieces.withColumn("_hash", F.xxhash64(*names))
    own = dealt.filter(F.col("length") >= capacity)
    # the high half tells full pieces' sequences from the groups'; ids are unique, not gapless
    alone = own.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).drop("_hash")
    shared = dealt.filter(F.col("length") < capacity).withColumn("_group", F.pmod("_hash", F.lit(groups)).cast("int"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_hash", kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(int(pdf["_group"].iloc[0]) << 32) + bins, offset=offsets)[[*names, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    packed = shared.groupBy("_group").applyInPandas(place, schema)
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: each document's place in sequences of ``capacity`` tokens."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id), capacity, group_pieces)
