"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs ``n + QUADRATIC * n**2`` (projections grow with n, attention with its
square).  A document's full runs of ``size`` tokens are sequences of their own.  What is left
of each document is dealt by a hash of its id and its place in the input, so that rows which repeat an
id spread too, to shards of a bounded number of documents; in a shard, remainders go in descending order to the cheapest sequence that has room.  The shard
opens just the sequences its tokens fill: as many of ``size`` as fit, and the powers of two
that make up the rest.  A remainder that no sequence can hold is cut to
fill the cheapest, so every sequence ends exactly full and nothing is padded.

A shard holds at most DOCS documents of under ``size`` tokens on average, whatever the corpus;
the number of shards grows with it.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, short_batches, table, utf8
from .tokens import default_path, tokenizer

SIZE, QUADRATIC = 2048, 1 / 4096
#: Documents to a shard, and full runs to a row.
DOCS, RUNS = 4096, 1024

_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
_PARTS = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("start", pa.int64()),
        ("runs", pa.list_(pa.int64())),
        ("rest", pa.binary()),
    ]
)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def assign(lengths: list[int], size: int = SIZE, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start in item, length, sequence, offset) of items shorter than ``size``.

    Sequence capacities sum to the tokens: full sizes first, then powers of two.
    """
    total = sum(lengths)
    capacity = [size] * (total // size) + [1 << b for b in reversed(range(size.bit_length())) if total % size >> b & 1]
    room, cost = np.array(capacity, np.int64), np.zeros(len(capacity))
    pieces: list[tuple[int, int, int, int, int]] = []
    waiting = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(waiting)
    while waiting:
        n, item, start = heapq.heappop(waiting)
        n = -n
        s = int(np.where(room >= n, cost, np.inf).argmin())
        if room[s] < n:  # none holds it whole
            s = int(cost.argmin())
        taken = min(n, int(room[s]))
        pieces.append((item, start, taken, s, capacity[s] - int(room[s])))
        room[s] -= taken
        cost[s] = cost[s] + taken + quadratic * taken * taken if room[s] else np.inf
        if taken < n:
            heapq.heappush(waiting, (taken - n, item, start + taken))
    return pieces


def _parts(path: str, size: int):
    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in it:
                for row, doc_id, ids in zip(b[0].to_pylist(), b[1].to_pylist(), tokenizer(path).encode(utf8(b[2])), strict=True):
                    full, n = len(ids) // size, len(ids)
                    sums = [crc(ids[i * size : (i + 1) * size]) for i in range(full)]
                    for k in range(0, full, RUNS):
                        yield row, doc_id, n, k * size, sums[k : k + RUNS], b""
                    if n % size:
                        yield row, doc_id, n, full * size, [], ids[full * size :].astype(kind).tobytes()

        kind = "<u2" if tokenizer(path).vocabulary <= 1 << 16 else "<u4"
        return batches(rows(), _PARTS, 512)

    return cut


def _pack(path: str, size: int):
    def pack(key: tuple, held: pa.Table) -> pa.Table:
        kind = "<u2" if tokenizer(path).vocabulary <= 1 << 16 else "<u4"
        held = held.sort_by([("doc_id", "ascending"), ("row", "ascending"), ("start", "ascending")])  # the same result on a retry
        names = ("doc_id", "doc_tokens", "start", "runs", "rest")
        rows = list(zip(*(held[x].to_pylist() for x in names), strict=True))
        rests = [np.frombuffer(r[4] or b"", kind) for r in rows]
        first, out = key[0].as_py() << 32, []
        pieces = assign([len(x) for x in rests], size)
        for item, start, n, s, offset in pieces:
            doc_id, tokens, at = rows[item][:3]
            out.append((doc_id, at + start, n, crc(rests[item][start : start + n]), tokens, first + s, offset))
        s = 1 + max((p[3] for p in pieces), default=-1)
        for doc_id, tokens, at, runs, _ in rows:
            for k, check in enumerate(runs):
                out.append((doc_id, at + k * size, size, check, tokens, first + s, 0))
                s += 1
        found = list(batches(iter(out), _PIECES))
        return pa.Table.from_batches(found, _PIECES)

    return pack


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, docs_in_shard: int = DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``size`` is a power of two.  Null and empty texts are the end id alone, a piece of one token.
    Each row is packed, repeated doc_ids too.  Empty table: no rows.  sequence_id is
    shard * 2**32 + position in the shard.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    short_batches(docs.sparkSession)
    shards = max(1, -(-docs.count() // docs_in_shard))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = numbered.mapInArrow(_parts(path, size), "row long, doc_id long, doc_tokens long, start long, runs array<long>, rest binary")
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("row", "doc_id", "start"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(
        _pack(path, size),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_path())


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
