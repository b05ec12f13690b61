"""Token ids in a binary format of shuffled planes.

Documents are dealt out by ranges of their id and sorted, so that shard after shard holds them in ascending order. A
shard is a run of segments, one row each: whole documents, about ``segment_ids`` ids. A segment's ids are cut into
fixed-size blocks (the last may be short). A block is transposed: byte plane k holds byte k of every id (or bit plane k
its bit k, eight ids to a byte); each plane is compressed alone with zstandard. The segment's chunk index has, for each
block, where it starts in the payload, how many ids it holds and how long each plane is, so any block can be read alone.
Segments are Parquet rows, so Spark's committers write them: a lost task leaves nothing half-written.

Defined cases: a null text counts as empty, and an empty text is the end id alone; documents with the same id are
ordered by their text, null first; null ids come first; a very long document makes one long segment; an empty table
makes no segment; other columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import conf, written
from tidemark.llm.words import batches, encoder

SEGMENT = (
    "shard int, segment int, start_in_shard bigint, n_ids bigint, doc_ids array<bigint>, doc_tokens array<bigint>, planes string, "
    "blocks array<struct<at: bigint, n_ids: int, sizes: array<int>>>, payload binary"
)
DOCUMENT = "doc_id bigint, shard int, start_in_shard bigint, n_tokens bigint, ids binary"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block of ``<u4`` ids."""
    if planes == "byte":
        return [x.tobytes() for x in ids.view(np.uint8).reshape(-1, 4).T]
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(x, bitorder="little").tobytes() for x in bits.T]


def from_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    rows = np.stack([np.frombuffer(x, np.uint8) for x in parts])
    if planes == "bit":
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        return np.packbits(bits.T, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.ascontiguousarray(rows.T).reshape(-1).view("<u4")


def pack_block_stream(data: bytes, block_ids: int, planes: str, level: int) -> tuple[list[dict], bytes]:
    """(chunk index, payload) of a segment's ids."""
    ids, compress = np.frombuffer(data, "<u4"), zstandard.ZstdCompressor(level=level).compress
    index, payload, at = [], [], 0
    for i in range(0, len(ids), block_ids):
        parts = [compress(x) for x in to_planes(ids[i : i + block_ids], planes)]
        index.append({"at": at, "n_ids": min(block_ids, len(ids) - i), "sizes": [len(x) for x in parts]})
        payload += parts
        at += sum(map(len, parts))
    return index, b"".join(payload)


def read_block(payload: bytes, block: dict, planes: str) -> np.ndarray:
    at, parts, decompress = block["at"], [], zstandard.ZstdDecompressor().decompress
    for n in block["sizes"]:
        parts.append(decompress(payload[at : at + n]))
        at += n
    return from_planes(parts, block["n_ids"], planes)


def write_segments(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    planes: str = "byte", block_ids: int = 1 << 16, segment_ids: int = 1 << 20, level: int = 3,
) -> DataFrame:
    """Encode, write in the shared folder, and return the written segments."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, start, enc = TaskContext.get().partitionId(), 0, 0, encoder(tokenizer, True)
        schema = None
        names, counts, held, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            index, payload = pack_block_stream(b"".join(held), block_ids, planes, level)
            row = {"shard": shard, "segment": segment, "start_in_shard": start, "n_ids": n, "doc_ids": names, "doc_tokens": counts, "planes": planes, "blocks": index, "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = _arrow_segment()
        for ids, texts in batches(rows):
            for name, data in zip(ids, enc.encode(texts), strict=True):
                held.append(data + end)
                names.append(name)
                counts.append(len(data) // 4 + 1)
                n += counts[-1]
                if n >= segment_ids:
                    yield flush()
                    segment, start = segment + 1, start + n
                    names, counts, held, n = [], [], [], 0
        if names:
            yield flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    with conf(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        return written(rows.mapInArrow(encode, SEGMENT), "token-segments", "uncompressed")


def _arrow_segment() -> pa.Schema:
    block = pa.struct([("at", pa.int64()), ("n_ids", pa.int32()), ("sizes", pa.list_(pa.int32()))])
    return pa.schema([
        ("shard", pa.int32()), ("segment", pa.int32()), ("start_in_shard", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())), ("planes", pa.string()), ("blocks", pa.list_(block)), ("payload", pa.binary()),
    ])


def shard_starts(segments: DataFrame) -> DataFrame:
    """(shard, shard_start): ids of all shards before. One row per written partition, so one task and a broadcast are enough."""
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def read_documents(segments: DataFrame, digest: bool = False) -> DataFrame:
    """Read segments back: doc_id, start (ids of all documents before it), n_tokens, ids (``<u4`` bytes; with ``digest`` their crc32 as ids_crc32)."""

    def decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for s in batch.to_pylist():
                ids = np.concatenate([read_block(s["payload"], b, s["planes"]) for b in s["blocks"]])
                ends = np.cumsum(s["doc_tokens"])
                data = [ids[e - n : e].tobytes() for e, n in zip(ends, s["doc_tokens"], strict=True)]
                last = pa.array([zlib.crc32(x) for x in data], pa.int64()) if digest else pa.array(data, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s["doc_ids"], pa.int64()),
                        pa.array([s["shard"]] * len(data), pa.int32()),
                        pa.array(ends - s["doc_tokens"] + s["start_in_shard"], pa.int64()),
                        pa.array(s["doc_tokens"], pa.int64()),
                        last,
                    ],
                    ["doc_id", "shard", "start_in_shard", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    made = segments.mapInArrow(decode, DOCUMENT.replace("ids binary", "ids_crc32 bigint") if digest else DOCUMENT)
    out = made.join(F.broadcast(shard_starts(segments)), "shard")
    return out.select("doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", made.columns[-1])
