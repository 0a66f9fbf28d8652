"""Token ids in binary files, coded by Simple-8b, and their reading back.

A file holds some documents, in order (all numbers little-endian):

    magic  8 bytes  "FRSTS8B1"
    n      4 x uint64: documents, ids, words, blocks
    table  documents x (int64 doc id, uint64 ids of the document), then documents x uint8: 1 where the doc id is null
    blocks blocks x uint64: the word at which each block of 4096 ids begins
    words  words x uint64

A word's high 4 bits select how many ids it holds and how wide they are (``COUNTS``, ``WIDTHS``), the first id in the
lowest bits. Selector 15 is an escape: the next word is one id of any 64-bit value. No word spans two blocks, so blocks
decode on their own, and all words of a selector decode at once.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, arrow_path
from .tokenization import SpacedPieces, encoder, in_parts

MAGIC = b"FRSTS8B1"
BLOCK = 4096
#: Ids in a file at least, but for a partition's last one; a longer document has a larger file.
FILE_IDS = 2_000_000
# Ids in a word, and bits of each, by selector; ids of all-zero runs aren't treated apart.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 64])
ESCAPE = 15


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the word at which each block begins, of unsigned ids."""
    words, starts, done = [], [], 0
    for at in range(0, len(ids), 512 * BLOCK):
        part, begin = _encode_blocks(ids[at : at + 512 * BLOCK].astype(np.uint64))
        words.append(part)
        starts.append(begin + done)
        done += len(part)
    return np.concatenate([*words, np.zeros(0, np.uint64)]), np.concatenate([*starts, np.zeros(0, np.uint64)]).astype(np.uint64)


_SHORT_BITS = np.maximum(np.frexp(np.arange(1 << 16, dtype=np.float64))[1], 1).astype(np.uint8)


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; up to one more from 2**53 on, which costs room only."""
    if len(ids) and ids.max() < 1 << 16:
        return _SHORT_BITS[ids]
    return np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)


def _encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    # blocks one below the other, with ids behind each that no selector holds, so that no word leaves its block
    widest = np.full((-(-n // BLOCK), BLOCK + int(COUNTS[0])), 255, np.uint8)
    widest[:, :BLOCK].flat[:n] = _bit_lengths(ids)
    selector = np.where(widest[:, :BLOCK] <= 60, 13, ESCAPE).astype(np.uint8)
    least, run = int(widest.min(initial=255)), 1  # widest: of the ``run`` ids from each position
    for s in range(12, -1, -1):  # the larger counts win
        if WIDTHS[s] < least:
            break
        while run < COUNTS[s]:
            step = min(run, int(COUNTS[s]) - run)
            widest, run = np.maximum(widest[:, :-step], widest[:, step:]), run + step
        np.copyto(selector, s, where=widest[:, :BLOCK] <= WIDTHS[s])
    selector = selector.ravel()
    # each block walks its words from its first id; all blocks step together
    here, stops = np.arange(0, n, BLOCK), np.minimum(np.arange(0, n, BLOCK) + BLOCK, n)
    block, begins = np.arange(len(here)), np.zeros(n, bool)
    while len(here):
        begins[here] = True
        here = here + COUNTS[selector[here]]
        left = here < stops[block]
        here, block = here[left], block[left]
    first = np.flatnonzero(begins)
    chosen = selector[first].astype(int)
    width = np.where(chosen == ESCAPE, 2, 1)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    for s in np.unique(chosen):
        own = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[place[own]] = np.uint64(ESCAPE) << np.uint64(60)
            words[place[own] + 1] = ids[first[own]]
            continue
        value, at = np.full(len(own), np.uint64(s) << np.uint64(60)), first[own]
        for k in range(COUNTS[s]):
            value |= ids[at + k] << np.uint64(k * WIDTHS[s])
        words[place[own]] = value
    return words, place[np.searchsorted(first, np.arange(0, n, BLOCK))]


def decode_words(words: np.ndarray, starts: np.ndarray, n_ids: int, blocks: range | None = None) -> np.ndarray:
    """The uint64 ids of some blocks, or of all."""
    blocks = range(len(starts)) if blocks is None else blocks
    if not len(blocks):
        return np.zeros(0, np.uint64)
    ids = np.zeros(min(n_ids, blocks.stop * BLOCK) - blocks.start * BLOCK, np.uint64)
    words = words[int(starts[blocks.start]) : int(starts[blocks.stop]) if blocks.stop < len(starts) else len(words)]
    selector = (words >> np.uint64(60)).astype(np.int64)
    # a word after an escape is a value; an escape-like value directly after an escape is no escape
    raw = np.zeros(len(words), bool)
    escapes = np.flatnonzero(selector == ESCAPE)
    if len(escapes):
        last = -2
        for w in escapes:
            if w != last + 1:
                raw[w + 1], last = True, w
    count = np.where(raw, 0, COUNTS[selector])
    place = np.cumsum(count) - count
    for s in np.unique(selector[~raw]):
        own = np.flatnonzero((selector == s) & ~raw)
        if s == ESCAPE:
            ids[place[own]] = words[own + 1]
            continue
        mask, at, value = np.uint64((1 << int(WIDTHS[s])) - 1), place[own], words[own]
        for k in range(COUNTS[s]):
            ids[at + k] = (value >> np.uint64(k * WIDTHS[s])) & mask
    return ids


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, starts = encode_ids(ids)
    table = np.zeros(len(doc_ids), [("doc", "<i8"), ("ids", "<u8")])
    table["doc"], table["ids"] = [d or 0 for d in doc_ids], lengths
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = np.array([len(doc_ids), len(ids), len(words), len(starts)], "<u8")
    return b"".join([MAGIC, head.tobytes(), table.tobytes(), null.tobytes(), starts.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def parse(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Doc ids, their numbers of ids, and all ids of a file."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    documents, n_ids, n_words, n_blocks = (int(x) for x in np.frombuffer(content, "<u8", 4, 8))
    at = 8 + 32
    table = np.frombuffer(content, [("doc", "<i8"), ("ids", "<u8")], documents, at)
    null = np.frombuffer(content, np.uint8, documents, at := at + table.nbytes)
    starts = np.frombuffer(content, "<u8", n_blocks, at := at + documents)
    words = np.frombuffer(content, "<u8", n_words, at + starts.nbytes)
    docs = [None if gone else int(d) for d, gone in zip(table["doc"], null, strict=True)]
    return docs, table["ids"].astype(np.int64), decode_words(words, starts, n_ids)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, file_ids: int = FILE_IDS, partitions: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes ``*.s8b`` files under ``path`` in ascending doc_id order (nulls first, equal ids by a hash of their texts) and returns the manifest.

    The manifest has part, file, n_docs and n_ids, and is stored beside the files. A file appears under its name only
    when it is whole, and a task that runs again writes the same bytes, so lost executors do no harm. Null texts count
    as empty. ``path`` has to be a URI that executors can write to (a file system that pyarrow knows).
    """
    spark = docs.sparkSession
    system, folder = fs.FileSystem.from_uri(arrow_path(path))
    system.create_dir(f"{folder}/files", recursive=True)
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(tokenizer, SpacedPieces).encode, TaskContext.get().partitionId()
        store, to = fs.FileSystem.from_uri(arrow_path(f"{path}/files"))
        keys: list[int | None] = []
        lengths: list[int] = []
        parts: list[bytes] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, lengths, parts, size, number
            name = f"{part:07d}-{number:06d}.s8b"
            draft = posixpath.join(to, f".{name}.{uuid.uuid4().hex}")
            with store.open_output_stream(draft) as out:
                out.write(file_bytes(keys, lengths, np.frombuffer(b"".join(parts), "<u4")))
            store.move(draft, posixpath.join(to, name))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([number], pa.int32()), "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([size], pa.int64())})
            keys, lengths, parts, size, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            texts, names = [t or "" for t in batch.column("text").to_pylist()], batch.column("doc_id").to_pylist()
            for begin, stop in in_parts(texts):
                for name, ids in zip(names[begin:stop], encode(texts[begin:stop]), strict=True):
                    ids += end
                    keys.append(name)
                    lengths.append(len(ids) // 4)
                    parts.append(ids)
                    size += len(ids) // 4
                    if size >= file_ids:
                        yield flush()
        if keys:
            yield flush()

    columns = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    # ranges are found from a sample of their keys, so these are short; the text itself only breaks ties
    keys = ["doc_id", F.xxhash64("text")]
    dealt = columns.repartitionByRange(partitions, *keys) if partitions else columns.repartitionByRange(*keys)
    done = dealt.sortWithinPartitions(*keys, "text").mapInArrow(write, "part int, file int, n_docs long, n_ids long")
    with arrow_batches(spark, 1000):
        done.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each stored document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, content in zip(*(batch.column(c).to_pylist() for c in ("part", "file", "content")), strict=True):
                docs, lengths, ids = parse(content)
                stops = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), lengths.tolist(), strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(stops - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], ["part", "file", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(f"{path}/files")
    named = files.select(F.regexp_extract("path", r"(\d+)-(\d+)\.s8b$", 1).cast("int").alias("part"), F.regexp_extract("path", r"(\d+)-(\d+)\.s8b$", 2).cast("int").alias("file"), "content")
    stored = named.mapInArrow(read, "part int, file int, doc_id long, at long, n_tokens long, ids_crc32 long")
    manifest = spark.read.parquet(f"{path}/manifest")
    # the only global order is over one number for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("_file_start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select("part", "file", (F.col("_part_start") + F.col("_file_start")).alias("_start"))
    return stored.join(starts, ["part", "file"]).select("doc_id", (F.col("_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
