"""Token-id files with fixed-width bit packing.

Every id takes the minimum bits of the vocabulary (16 for 49,408 ids).  Blocks of BLOCK ids
are packed on their own; the file's footer has the offset of each block and the first id of
each document, so numpy unpacks whole blocks and any document is reached without reading the
rest.  Layout, little-endian:

    magic 8 bytes | bits u32 | ids a block u32 | packed blocks ...
    block offsets u64[blocks + 1] | doc ids i64[docs] | doc starts u64[docs + 1]
    blocks u64 | docs u64 | ids u64 | magic 8 bytes

Files are dealt by ranges of doc_id.  A task writes its file under a name of its own and moves
it into place when it is whole; the table of files is written by Spark and names only files of
tasks that succeeded, so a lost or repeated task leaves at most an unnamed file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, shared_dir, short_batches, stored, table, text_key, utf8
from .tokens import default_path, tokenizer

MAGIC, BLOCK = b"TOKPACK1", 8192
#: Stands in a file for a document without an id.
NO_ID = -(1 << 63)
_HEAD, _TAIL = struct.Struct("<8sII"), struct.Struct("<QQQ8s")


def width_of(vocabulary: int) -> int:
    """Bits that hold every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids fill ``bits`` bytes; the last eight are padded with zeros."""
    lanes = np.zeros(-(-len(ids) // 8) * 8, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(-1, 8)
    out = np.zeros((len(lanes), bits), np.uint8)
    for k in range(8):
        low = k * bits
        for j in range(low // 8, (low + bits - 1) // 8 + 1):
            shift = low - 8 * j
            part = lanes[:, k] << np.uint64(shift) if shift >= 0 else lanes[:, k] >> np.uint64(-shift)
            out[:, j] |= part.astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, bits)
    out = np.zeros((len(raw), 8), np.uint64)
    for k in range(8):
        low = k * bits
        for j in range(low // 8, (low + bits - 1) // 8 + 1):
            shift = 8 * j - low
            part = raw[:, j].astype(np.uint64)
            out[:, k] |= part << np.uint64(shift) if shift >= 0 else part >> np.uint64(-shift)
    return (out.reshape(-1)[:n] & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Writes documents' ids to one open stream; keeps 16 bytes a document for the footer."""

    def __init__(self, stream, vocabulary: int, block: int = BLOCK):
        if block % 8:
            raise ValueError("a block holds a multiple of eight ids")
        self.stream, self.bits, self.block = stream, width_of(vocabulary), block
        self.held, self.n_held, self.ids = [], 0, 0
        self.offsets, self.docs, self.starts = [_HEAD.size], [], [0]
        stream.write(_HEAD.pack(MAGIC, self.bits, block))

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.ids += len(ids)
        self.starts.append(self.ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 32 * self.block:
            self._flush(self.n_held // self.block * self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for k in range(0, n, self.block):
            data = pack(ids[k : min(n, k + self.block)], self.bits)
            self.stream.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_held)
        self.stream.write(np.array(self.offsets, "<u8").tobytes())
        self.stream.write(np.array(self.docs, "<i8").tobytes())
        self.stream.write(np.array(self.starts, "<u8").tobytes())
        self.stream.write(_TAIL.pack(len(self.offsets) - 1, len(self.docs), self.ids, MAGIC))
        self.stream.close()


class Reader:
    """Random access to one file: by position of an id, or by position of a document."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        blocks, docs, self.n_ids, magic = _TAIL.unpack(self._at(size - _TAIL.size, _TAIL.size))
        first, self.bits, self.block = _HEAD.unpack(self._at(0, _HEAD.size))
        if magic != MAGIC or first != MAGIC:
            raise ValueError("not a token file, or an unfinished one")
        foot = self._at(size - _TAIL.size - 8 * (blocks + 2 * docs + 2), 8 * (blocks + 2 * docs + 2))
        self.offsets = np.frombuffer(foot, "<u8", blocks + 1).astype(np.int64)
        self.doc_ids = np.frombuffer(foot, "<i8", docs, 8 * (blocks + 1))
        self.starts = np.frombuffer(foot, "<u8", docs + 1, 8 * (blocks + 1 + docs)).astype(np.int64)

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids at positions start to stop, from the blocks that hold them only."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block + 1
        data = self._at(int(self.offsets[a]), int(self.offsets[b] - self.offsets[a]))
        n = min(self.n_ids, b * self.block) - a * self.block
        return unpack(data, self.bits, n)[start - a * self.block : stop - a * self.block]

    def documents(self, ahead: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) in file order, unpacking about ``ahead`` ids at a time."""
        k = 0
        while k < len(self.doc_ids):
            stop = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + ahead, "right")) - 1)
            stop = min(stop, len(self.doc_ids))
            base = int(self.starts[k])
            ids = self.ids(base, int(self.starts[stop]))
            for i in range(k, stop):
                a, b = int(self.starts[i]), int(self.starts[i + 1])
                doc_id = int(self.doc_ids[i])
                yield None if doc_id == NO_ID else doc_id, a, ids[a - base : b - base]
            k = stop


def _writer(path: str, folder: str):
    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "first_id", "first_key", "n_docs", "n_ids"]
        out, where, name, place, first = None, None, None, None, None
        for b in it:
            if b.num_rows and out is None:
                where, place = fs.FileSystem.from_uri(folder)
                where.create_dir(place, recursive=True)
                name = uuid.uuid4().hex
                first = b[1][0].as_py()
                out = Writer(where.open_output_stream(f"{place}/.{name}.part"), tokenizer(path).vocabulary)
            for doc_id, ids in zip(b[0].to_pylist(), tokenizer(path).encode(utf8(b[2])), strict=True):
                out.add(doc_id, ids)
        if out is not None:
            out.close()
            where.move(f"{place}/.{name}.part", f"{place}/{name}.tok")
            yield pa.RecordBatch.from_pydict(
                dict(zip(names, ([f"{folder}/{name}.tok"], [out.docs[0]], [first], [len(out.docs)], [out.ids]), strict=True))
            )

    return write


def write_tokens(docs: DataFrame, folder: str, path: str) -> DataFrame:
    """Write ``docs`` (doc_id, text) in ascending doc_id order; the table of files is returned.

    Columns: path, first_id, first_key, n_docs, n_ids, base (ids in all files before).  Null and empty
    texts get the end id alone.  Empty table: no file.  Rows that repeat a doc_id stand side by side in the order of
    a hash of their texts, over several files where they are many; those without an id come first.
    """
    short_batches(docs.sparkSession)
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    ordered = keyed.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    files = stored(ordered.mapInArrow(_writer(path, folder), "path string, first_id long, first_key long, n_docs long, n_ids long"), "token-files")
    before = Window.orderBy("first_id", "first_key").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


_ROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in it:
            for uri, base in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                where, place = fs.FileSystem.from_uri(uri)
                with where.open_input_file(place) as f:
                    for doc_id, start, ids in Reader(f).documents():
                        yield doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    return batches(rows(), _ROW)


def read_digests(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start over all files, n_tokens, ids_crc32."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("path", "base").repartition(n, "path")
    return dealt.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read_digests(write_tokens(table(spark, sf_dir, "documents"), folder, default_path()))


QUERIES = {"op7_token_file": op7_token_file}
ORACLES: dict[str, str] = {}
