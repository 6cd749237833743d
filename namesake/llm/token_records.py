"""Token ids in length-delimited binary records, with an offset index for reads in any order.

A shard holds records one after the other:

    length of the payload   unsigned 64-bit
    masked checksum of the length bytes   unsigned 32-bit
    payload
    masked checksum of the payload   unsigned 32-bit

all little-endian. The payload is doc_id (signed 64-bit), 1 if doc_id is null else 0 (one byte), the width of an id in bytes
(one byte: 2 where the vocabulary allows it, else 4), and the ids. A checksum is CRC-32, rotated right by 15 bits
plus a constant, so that a checksum over data that holds checksums stays useful. The index beside a shard holds one unsigned
64-bit offset for each record.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import lean
from ._pretokens import PieceTable
from ._store import new_path, written

#: Added to a rotated checksum; the usual constant of such record files.
MASK = 0xA282EAD8
#: Pieces whose ids a worker keeps, some 200 bytes each.
KEPT = 700_000
_HEAD = struct.Struct("<QI")
_DOC = struct.Struct("<qBB")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def record(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return frame(_DOC.pack(doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes())


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record at ``at``, and where the next begins; ValueError on damage."""
    if len(data) < at + _HEAD.size:
        raise ValueError(f"record at {at} is cut off")
    length, check = _HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"record at {at}: damaged length")
    begin = at + _HEAD.size
    payload = data[begin : begin + length]
    if len(data) < begin + length + 4:
        raise ValueError(f"record at {at} is cut off")
    if struct.unpack_from("<I", data, begin + length)[0] != masked(payload):
        raise ValueError(f"record at {at}: damaged payload")
    return payload, begin + length + 4


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = _DOC.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=_DOC.size).astype("<u4")


def read_shard(path: str, index_path: str, order: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of a shard by the numbers in ``order`` (all, as they stand, if None), each by one read at its offset."""
    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_stream(fs.FileSystem.from_uri(index_path)[1]) as f:
        offsets = np.frombuffer(f.read(), "<u8")
    with store.open_input_file(place) as f:
        if order is None:
            with store.open_input_stream(place, buffer_size=1 << 20) as s:
                for _ in offsets:
                    head = s.read(_HEAD.size)
                    yield parsed(unframe(head + s.read(_HEAD.unpack(head)[0] + 4))[0])
            return
        ends = np.append(offsets[1:], f.size())
        for k in order:
            yield parsed(unframe(f.read_at(int(ends[k] - offsets[k]), int(offsets[k])))[0])


@lru_cache(maxsize=2)
def _table(path: str) -> PieceTable:
    return PieceTable(path, kept=KEPT)


def _write(tokenizer: str, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        table = _table(tokenizer)
        width = 2 if max(table.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        name = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        store, place = fs.FileSystem.from_uri(f"{name}.tok")
        offsets, tokens, at = [], 0, 0
        end = np.array([end_id], "<u4")
        out = None
        for batch in batches:
            if out is None:
                out = store.open_output_stream(place, buffer_size=1 << 20)
            names = batch.column("doc_id").to_pylist()
            for i, codes in table.encoded(batch.column("text")):
                for doc_id, code in zip(names[i : i + len(codes)], codes, strict=True):
                    ids = np.concatenate((np.frombuffer(code, "<u4"), end))
                    data = record(doc_id, ids, width)
                    out.write(data)
                    offsets.append(at)
                    at += len(data)
                    tokens += len(ids)
        if out is not None:
            out.close()
            with store.open_output_stream(fs.FileSystem.from_uri(f"{name}.idx")[1]) as f:
                f.write(np.array(offsets, "<u8").tobytes())
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": f"{name}.tok", "index_path": f"{name}.idx", "records": len(offsets), "tokens": tokens}])

    return run


def write_token_records(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` and writes shards in ascending doc_id order below ``folder``, a URI that all executors
    see; returns the manifest: shard, path, index_path, records, tokens and start (ids in all shards before it).

    Null texts are empty (one id, the end id); null doc_ids come first; rows with the same doc_id follow in a fixed order,
    by a hash of their texts. An empty table has an empty manifest. A task that runs again writes files of its own, and
    the manifest names only those of the run that counted.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = chosen.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    made = written(dealt.mapInArrow(lean(_write(tokenizer, folder, end_id)), "shard long, path string, index_path string, records long, tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return made.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.to_pylist():
            rows, at = [], shard["start"]
            for doc_id, ids in read_shard(shard["path"], shard["index_path"]):
                rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at += len(ids)
            doc, start, n, crc = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, n, crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_records(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record, read back from the shards that ``manifest`` lists."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "shard").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_records(write_token_records(docs, public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "tokens")))
