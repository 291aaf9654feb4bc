"""Token-ID output as patched frame-of-reference blocks.

A segment file holds whole documents in order:

    magic ``QPF1``, then little-endian: partition u32, sequence u32, block length u32,
    documents u64, tokens u64, blocks u64
    doc_id i64 for each document (the least i64 stands for null)
    end offset u64 of each document, in tokens
    byte start u64 of each block, and the end of the last
    blocks: minimum u32, width u8, exceptions u16, the low ``width`` bits of value - minimum in
    32-bit words from the lowest bit on, positions u16 and high bits u32 of the exceptions

The width of a block is the bit length of a percentile of its offsets, so a few large ids do
not widen the rest; they go to the exception list.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import join_small, materialize, scratch

MAGIC, HEAD = b"QPF1", struct.Struct("<4sIIIQQQ")
#: Tokens of a block, a multiple of 32.
BLOCK = 512
#: Texts that a task holds as Python strings at a time.
TEXTS = 256
NULL_ID = -(2**63)
_BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("n", "<u2")])


def _squeeze(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each row's values, put together in 32-bit words; 32 values make ``width`` words."""
    n, block = values.shape
    out = np.zeros((width, n, block // 32), np.uint32)
    if width:
        turned = np.ascontiguousarray(values.reshape(n, -1, 32).transpose(2, 0, 1)) & np.uint32(2**width - 1)
        for i in range(32):
            word, shift = divmod(i * width, 32)
            out[word] |= turned[i] << np.uint32(shift)
            if shift + width > 32:
                out[word + 1] |= turned[i] >> np.uint32(32 - shift)
    return np.ascontiguousarray(out.transpose(1, 2, 0)).reshape(n, -1)


def _spread(words: np.ndarray, width: int, block: int) -> np.ndarray:
    """The values that ``_squeeze`` put into rows of words."""
    out = np.zeros((32, len(words), block // 32), np.uint32)
    if width:
        turned = np.ascontiguousarray(words.reshape(len(words), -1, width).transpose(2, 0, 1))
        for i in range(32):
            word, shift = divmod(i * width, 32)
            out[i] = turned[word] >> np.uint32(shift)
            if shift + width > 32:
                out[i] |= turned[word + 1] << np.uint32(32 - shift)
        out &= np.uint32(2**width - 1)
    return np.ascontiguousarray(out.transpose(1, 2, 0)).reshape(len(words), block)


def pack(values: np.ndarray, block: int = BLOCK, percentile: float = 90.0) -> tuple[list[bytes], np.ndarray]:
    """Blocks of unsigned 32-bit ``values`` as bytes, and the byte length of each.

    The last block may be shorter; its missing values are packed as the block's minimum.
    """
    n = len(values)
    nb = -(-n // block)
    if not nb:
        return [], np.zeros(0, np.int64)
    padded = np.empty(nb * block, np.uint32)
    padded[:n] = values
    padded[n:] = values[(nb - 1) * block :].min()
    grid = padded.reshape(nb, block)
    low = grid.min(1)
    delta = grid - low[:, None]
    k = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    at = np.partition(delta, k, axis=1)[:, k]
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.uint8)
    out: list[bytes] = [b""] * nb
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        d = delta[rows]
        high = d >> np.uint32(w) if w < 32 else np.zeros_like(d)
        packed = _squeeze(d, w)
        found, places = np.nonzero(high)
        ends = np.searchsorted(found, np.arange(1, len(rows) + 1)).tolist()
        places, rest = places.astype("<u2"), high[found, places].astype("<u4")
        first = 0
        for i, (r, last) in enumerate(zip(rows.tolist(), ends, strict=True)):
            head = np.array((low[r], w, last - first), _BLOCK_HEAD).tobytes()
            out[r] = b"".join((head, packed[i].tobytes(), places[first:last].tobytes(), rest[first:last].tobytes()))
            first = last
    return out, np.array([len(b) for b in out], np.int64)


def unpack(data: memoryview, starts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` values of the blocks that begin at ``starts``, whose last entry is the end."""
    out = np.empty((len(starts) - 1) * block, np.uint32)
    heads = [np.frombuffer(data, _BLOCK_HEAD, 1, int(s))[0] for s in starts[:-1]]
    widths = np.array([h["width"] for h in heads], np.int64)
    grid = out.reshape(-1, block)
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        size = block * int(w) // 8
        raw = np.stack([np.frombuffer(data, np.uint8, size, int(starts[r]) + _BLOCK_HEAD.itemsize) for r in rows])
        values = _spread(raw.view("<u4"), int(w), block)
        for i, r in enumerate(rows):
            m = int(heads[r]["n"])
            if m:
                at = int(starts[r]) + _BLOCK_HEAD.itemsize + size
                where = np.frombuffer(data, "<u2", m, at)
                values[i, where] |= np.frombuffer(data, "<u4", m, at + 2 * m) << np.uint32(w)
            grid[r] = values[i] + heads[r]["low"]
    return out[:n]


class SegmentWriter:
    """Gathers documents, packs every ``chunk`` tokens, and gives the file's bytes at the end."""

    def __init__(self, partition: int, sequence: int, chunk: int = BLOCK * 512):
        self.partition, self.sequence, self.chunk = partition, sequence, chunk
        self.ids: list[int] = []
        self.ends: list[int] = []
        self.tokens = self._waiting = self.packed = 0
        self._raw: list[bytes] = []
        self._blocks: list[bytes] = []
        self._sizes: list[np.ndarray] = []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.tokens += len(raw) // 4
        self.ends.append(self.tokens)
        self._raw.append(raw)
        self._waiting += len(raw) // 4
        if self._waiting >= self.chunk:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        values = np.frombuffer(b"".join(self._raw), "<u4")
        n = len(values) if last else len(values) // BLOCK * BLOCK
        blocks, sizes = pack(values[:n])
        self._blocks += blocks
        self._sizes.append(sizes)
        self.packed += int(sizes.sum())
        self._raw = [values[n:].tobytes()]
        self._waiting = len(values) - n

    def bytes(self) -> bytes:
        self._flush(True)
        sizes = np.concatenate(self._sizes)
        first = HEAD.size + 16 * len(self.ids) + 8 * (len(sizes) + 1)
        starts = first + np.concatenate([[0], np.cumsum(sizes)])
        head = HEAD.pack(MAGIC, self.partition, self.sequence, BLOCK, len(self.ids), self.tokens, len(sizes))
        return b"".join((head, np.array(self.ids, "<i8").tobytes(), np.array(self.ends, "<u8").tobytes(), starts.astype("<u8").tobytes(), *self._blocks))


def read_segment(content: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Partition, sequence, doc ids, end offsets and all ids of a segment file."""
    magic, partition, sequence, block, docs, tokens, blocks = HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a segment file")
    at = HEAD.size
    ids = np.frombuffer(content, "<i8", docs, at)
    ends = np.frombuffer(content, "<u8", docs, at + 8 * docs).astype(np.int64)
    starts = np.frombuffer(content, "<u8", blocks + 1, at + 16 * docs).astype(np.int64)
    return partition, sequence, ids, ends, unpack(memoryview(content), starts, tokens, block)


def read_document(content: bytes, position: int) -> np.ndarray:
    """The ids of one document of a segment, from the blocks that hold it alone."""
    _, _, _, block, docs, _, blocks = HEAD.unpack_from(content)
    ends = np.frombuffer(content, "<u8", docs, HEAD.size + 8 * docs).astype(np.int64)
    starts = np.frombuffer(content, "<u8", blocks + 1, HEAD.size + 16 * docs).astype(np.int64)
    lo, hi = (int(ends[position - 1]) if position else 0), int(ends[position])
    b0, b1 = lo // block, -(-hi // block)
    values = unpack(memoryview(content), starts[b0 : b1 + 1], (b1 - b0) * block, block) if hi > lo else np.zeros(0, np.uint32)
    return values[lo - b0 * block : hi - b0 * block]


def _store(folder: str, name: str, content: bytes) -> None:
    """Put a file in any store that pyarrow opens; the last step is a rename, so a task that is
    run twice leaves one whole file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, f"{path}/{name}")


def write_token_blocks(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 32 << 20) -> DataFrame:
    """Encode whole texts and write their ids as segment files, in ascending order of id.

    Documents are dealt out by ranges of ``id_col``, so file order is id order; each task keeps
    one segment of about ``segment_bytes`` in memory. Null texts count as empty and give the end
    id alone; null ids come first; repeated ids are all written, ties in order of the text's hash,
    and ranges cut through them; an empty table writes no file. Returns the manifest, one row a
    file: partition, sequence, name, docs, tokens.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.llm.tokens import encoder

        enc, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        partition, sequence = TaskContext.get().partitionId(), 0
        writer = SegmentWriter(partition, 0)

        def close() -> pa.RecordBatch:
            name = f"segment-{writer.partition:06d}-{writer.sequence:06d}.qpf"
            _store(folder, name, writer.bytes())
            return pa.RecordBatch.from_pydict({"partition": [writer.partition], "sequence": [writer.sequence], "name": [name], "docs": [len(writer.ids)], "tokens": [writer.tokens]})

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):  # few texts at a time as Python strings
                some = batch.slice(at, TEXTS)
                for key, text in zip(some.column("key").to_pylist(), some.column("text").to_pylist(), strict=True):
                    writer.add(key, enc.ids(text or "") + end)
                    if writer.packed >= segment_bytes:
                        yield close()
                        sequence += 1
                        writer = SegmentWriter(partition, sequence)
        if writer.ids:
            yield close()

    # rows equal in id and text may stand in any order, so their numbers may cut a range too
    order = ["key", "hash", "number"]
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.xxhash64(text_col).alias("hash"), F.monotonically_increasing_id().alias("number"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    return materialize(rows.mapInArrow(encode, "partition long, sequence long, name string, docs long, tokens long"), "manifest")


def read_token_blocks(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Read segment files back: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                partition, sequence, ids, ends, values = read_segment(bytes(content))
                begins = np.concatenate([[0], ends[:-1]])
                raw = memoryview(values.astype("<u4").tobytes())
                yield pd.DataFrame({
                    "partition": partition, "sequence": sequence,
                    "doc_id": pd.Series(ids, dtype="Int64").mask(ids == NULL_ID),
                    "begin": begins, "n_tokens": ends - begins,
                    "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)],
                })

    spark_files = spark.read.format("binaryFile").option("pathGlobFilter", "*.qpf").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    found = spark_files.select("content").mapInPandas(decode, "partition long, sequence long, doc_id long, begin long, n_tokens long, ids_crc32 long")
    order = Window.orderBy("partition", "sequence").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    base = manifest.select("partition", "sequence", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base"))
    return join_small(found, base, ["partition", "sequence"], rows=manifest.count()).select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def token_blocks(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the ids of all documents to ``folder`` (the shared one by default) and read them back."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "segments")
    manifest = write_token_blocks(docs, folder, vocabulary, end_id)
    if not manifest.head(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_blocks(spark, folder, manifest)
