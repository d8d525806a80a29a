"""Token ids as Arrow files of equal-length sequences, with random access to any sequence or document."""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from eventstrand.llm.common import Scratch
from eventstrand.llm.tokens import by_bytes, encoder

BATCH_SEQUENCES = 128


def sequence_schema(length: int, bits: int) -> pa.Schema:
    ids = pa.uint16() if bits == 16 else pa.uint32()
    return pa.schema([("input_ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


INDEX_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
SHARD_SCHEMA = "shard int, sequences string, index string, n_docs long, n_tokens long"


class _File:
    """An Arrow file under a name of its own until it is complete, so a lost task leaves no half file."""

    def __init__(self, uri: str, schema: pa.Schema):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.sink = self.fs.open_output_stream(self.part)
        self.writer = pa.ipc.new_file(self.sink, schema)

    def close(self) -> None:
        self.writer.close()
        self.sink.close()
        self.fs.move(self.part, self.path)


class ShardWriter:
    """Cuts a stream of ids into sequences of ``length``; the last one is padded and masked."""

    def __init__(self, folder: str, shard: int, length: int, bits: int):
        self.names = [f"{folder}/{kind}-{shard:06d}.arrow" for kind in ("sequences", "index")]
        self.schema = sequence_schema(length, bits)
        self.length, self.dtype = length, np.uint16 if bits == 16 else np.uint32
        self.sequences = _File(self.names[0], self.schema)
        self.index = _File(self.names[1], INDEX_SCHEMA)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_tokens = self.n_docs = 0

    def add(self, doc_ids: list[int | None], encoded: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in encoded], dtype=np.int64)
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.index.writer.write_batch(
            pa.record_batch([pa.array(doc_ids, pa.int64()), starts, sizes], schema=INDEX_SCHEMA)
        )
        self.n_docs += len(sizes)
        self.n_tokens += int(sizes.sum())
        self.waiting += encoded
        self.n_waiting += int(sizes.sum())
        if self.n_waiting >= BATCH_SEQUENCES * self.length:
            self._flush(pad=False)

    def _flush(self, pad: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        step = BATCH_SEQUENCES * self.length
        whole = len(ids) if pad else len(ids) // step * step
        for at in range(0, whole, step):
            self._write(ids[at : min(at + step, whole)])
        self.waiting = [ids[whole:]]
        self.n_waiting = len(ids) - whole

    def _write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        values = np.zeros(rows * self.length, self.dtype)
        values[: len(ids)] = ids
        mask = np.arange(len(values)) < len(ids)
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (values, mask)
        ]
        self.sequences.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(pad=True)
        self.sequences.close()
        self.index.close()


class SequenceFile:
    """Zero-copy access to the sequences of one file; local files are mapped, not read."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("input_ids").type.list_size
        self._at, self._values = -1, None

    def _batch(self, k: int) -> pa.RecordBatch:
        return self.reader.get_batch(k)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``."""
        batch, row = self._batch(i // BATCH_SEQUENCES), i % BATCH_SEQUENCES
        ids, mask = (c.slice(row, 1).flatten() for c in batch.columns)
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from token ``start`` of the file's stream."""
        step, parts = BATCH_SEQUENCES * self.length, []
        while count > 0:
            k = start // step
            if k != self._at:
                self._at, self._values = k, self._batch(k).column(0).flatten().to_numpy()
            part = self._values[start - k * step : start - k * step + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]

    def close(self) -> None:
        self.source.close()


def write_token_files(
    df: DataFrame, folder: str, vocabulary: str, end_id: int, length: int = 2048, bits: int = 16
) -> DataFrame:
    """Encode every whole text, append ``end_id``, write shards in ascending ``doc_id`` order below ``folder``.

    ``df`` needs ``doc_id`` and ``text``; other columns are ignored.  A null text counts as empty and gives
    the end id alone; null ids come first; rows that share an id all stay, ordered by text.  ``bits`` is 16
    or 32; an ``end_id`` or a vocabulary that does not fit is refused.  An empty table gives no shard.  Documents are range-partitioned, so
    one task writes one shard and its place follows from the sizes of the shards before it.  Returns one
    row per shard, to be stored by the caller before it is read twice.
    """
    largest = max(encoder(vocabulary).largest_id, end_id)
    if bits not in (16, 32) or largest >= 1 << bits or end_id < 0:
        raise ValueError(f"ids up to {largest} do not fit {bits} bits")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        shard = TaskContext.get().partitionId()
        writer = None
        for batch in batches:
            if batch.num_rows:
                writer = writer or ShardWriter(folder, shard, length, bits)
                doc_ids, at = batch.column(0).to_pylist(), 0
                for texts in by_bytes(batch.column(1)):
                    ids = [np.frombuffer(e + end, "<u4") for e in encode(texts.to_pylist())]
                    writer.add(doc_ids[at : at + len(ids)], ids)
                    at += len(ids)
        if writer:
            writer.close()
            row = [[shard], *([n] for n in writer.names), [writer.n_docs], [writer.n_tokens]]
            types = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch(
                [pa.array(v, t) for v, t in zip(row, types, strict=True)],
                names=["shard", "sequences", "index", "n_docs", "n_tokens"],
            )

    ordered = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    return ordered.sortWithinPartitions("doc_id", "text").mapInArrow(write, SHARD_SCHEMA)


def read_token_files(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files of ``shards``.

    ``start`` counts the ids of all documents before; ``ids_crc32`` covers the ids as little-endian
    unsigned 32-bit integers.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["index"])
                file = SequenceFile(row["sequences"])
                with fs.open_input_file(path) as source:
                    reader = pa.ipc.open_file(source)
                    for k in range(reader.num_record_batches):
                        index = reader.get_batch(k)
                        spans = zip(index.column(1).to_pylist(), index.column(2).to_pylist(), strict=True)
                        crc = [zlib.crc32(file.tokens(*span).astype("<u4").tobytes()) for span in spans]
                        starts = pa.array(index.column(1).to_numpy() + row["before"])
                        yield pa.record_batch(
                            [index.column(0), starts, index.column(2), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                file.close()

    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    before = F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("before")
    placed = shards.select("shard", "sequences", "index", before)
    n = max(1, shards.sparkSession.sparkContext.defaultParallelism)
    return placed.repartition(max(n, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def roundtrip(df: DataFrame, vocabulary: str, end_id: int, length: int = 2048) -> DataFrame:
    """Write the token files, read them back and return what they hold per document."""
    with Scratch(df.sparkSession, "token-files") as scratch:
        written = write_token_files(df, scratch.path("files"), vocabulary, end_id, length)
        shards = scratch.keep(written, "shards")
        return scratch.hand_over(read_token_files(shards))
