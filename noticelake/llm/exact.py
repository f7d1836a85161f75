"""Exact deduplication through an extendible-hash index on shared files.

The 64-bit hash of a text is the key.  A directory of 2**g slots (g: global depth) maps the
top g bits of a key to a bucket; splitting starts from one bucket and halves every bucket
over its capacity by one more bit, doubling the directory when the bucket already uses all g
bits.  Bucket loads come from a histogram of hash prefixes that Spark counts, so the
directory is at most 2**MAX_DEPTH slots whatever the corpus; a bucket that is still too full
there keeps its surplus as overflow pages, which cost a longer scan and never a lost row.

Each bucket has one owner task, which has a range of keys.  It walks the bucket in key order,
follows the chain of each key and compares bytes, so texts whose hashes collide stay apart.
Documents find their bucket through the directory and their entry in it by key and digest.  The
index goes to the shared folder; a task that dies is simply run again, since it only reads the tables.

Hot keys: every map task first folds its own equal texts into one entry, so an owner meets
one entry a map task and text, not one a copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, one_space, short_batches, stored, table, text_key, utf8

#: Entries a bucket holds before it splits, and the most bits the directory uses.
CAPACITY, MAX_DEPTH = 64, 16
#: Bytes of text that a map task folds before it passes its entries on.
FOLD_BYTES = 32 << 20

_ENTRY = pa.schema([("h", pa.int64()), ("norm", pa.binary()), ("keep_id", pa.int64()), ("copies", pa.int64())])
_INDEX = pa.schema(
    [
        ("bucket", pa.int32()),
        ("h", pa.int64()),
        ("chain", pa.int32()),
        ("text_sha256", pa.string()),
        ("keep_id", pa.int64()),
        ("group_size", pa.int64()),
    ]
)


def _fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of one task become one entry: smallest id, number of copies."""
    held: dict[bytes, list[int]] = {}
    size = 0
    for b in it:
        for doc_id, h, text in zip(b[0].to_pylist(), b[1].to_pylist(), utf8(b[2]), strict=True):
            if entry := held.get(text):
                entry[1] = min(entry[1], doc_id)
                entry[2] += 1
            else:
                held[text] = [h, doc_id, 1]
                size += len(text) + 100
        if size > FOLD_BYTES:
            yield from _entries(held)
            held, size = {}, 0
    yield from _entries(held)


def _entries(held: dict[bytes, list[int]]) -> Iterator[pa.RecordBatch]:
    return batches(((h, text, k, n) for text, (h, k, n) in held.items()), _ENTRY, 256)


def _own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner task: rows come in order of bucket and key; one index row for each text."""

    def rows():
        at, chain = None, {}
        for b in it:
            columns = (b[0].to_pylist(), b[1].to_pylist(), utf8(b[2]), b[3].to_pylist(), b[4].to_pylist())
            for bucket, h, text, keep, copies in zip(*columns, strict=True):
                if (bucket, h) != at:
                    yield from links(at, chain)
                    at, chain = (bucket, h), {}
                if link := chain.get(text):  # a dict compares the bytes of equal hashes
                    link[0] = min(link[0], keep)
                    link[1] += copies
                else:
                    chain[text] = [keep, copies]
        yield from links(at, chain)

    def links(at, chain):
        for k, (text, (keep, copies)) in enumerate(chain.items()):
            yield (*at, k, hashlib.sha256(text).hexdigest(), keep, copies)

    return batches(rows(), _INDEX)


def directory(loads: dict[int, int], depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """(slot, bucket, local depth) for every slot at the final global depth.

    ``loads`` has the number of entries by the top ``depth`` bits.  A bucket is a prefix; it
    splits while it is over ``capacity`` and has bits left.  Empty input: one bucket, depth 0.
    """
    buckets, full = {}, [(0, 0)]  # (prefix, local depth)
    sums = [{} for _ in range(depth + 1)]
    sums[depth] = dict(loads)
    for d in range(depth, 0, -1):
        for p, n in sums[d].items():
            sums[d - 1][p >> 1] = sums[d - 1].get(p >> 1, 0) + n
    global_depth = 0
    while full:
        prefix, local = full.pop()
        if sums[local].get(prefix, 0) > capacity and local < depth:
            if local == global_depth:
                global_depth += 1  # the directory doubles
            full += [(prefix << 1, local + 1), (prefix << 1 | 1, local + 1)]
        else:
            buckets[prefix, local] = None
    slots = []
    for k, (prefix, local) in enumerate(sorted(buckets, key=lambda x: x[0] << (depth - x[1]))):
        spread = global_depth - local
        slots += [(prefix << spread | i, k, local) for i in range(1 << spread)]
    return slots


def find_bucket(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH):
    """The directory for the keys ``h`` of ``docs``: a function that adds ``bucket`` to rows, and the number of buckets."""
    spark = docs.sparkSession
    prefix = F.shiftrightunsigned("h", 64 - max_depth)
    # at most 2**max_depth rows reach the driver
    loads = {r.prefix: r.n for r in docs.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n")).collect()}
    slots = directory(loads, max_depth, capacity)
    depth = (len(slots) - 1).bit_length()
    slot = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
    where = F.broadcast(spark.createDataFrame(slots, "slot long, bucket int, local_depth int").drop("local_depth"))
    return lambda rows: rows.withColumn("slot", slot).join(where, "slot").drop("slot"), 1 + max(b for _, b, _ in slots)


def build_index(docs: DataFrame, find, buckets: int) -> DataFrame:
    """The index of ``docs`` (doc_id, norm, h): bucket, h, chain, text_sha256, keep_id, group_size.

    Buckets are numbered in key order and dealt to owner tasks in runs, so an owner has a range of keys.
    """
    short_batches(docs.sparkSession)
    entries = docs.select("doc_id", "h", "norm").mapInArrow(_fold, "h long, norm binary, keep_id long, copies long")
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owner = F.floor(F.col("bucket").cast("long") * owners / buckets).cast("int")
    owned = find(entries).select("bucket", "h", "norm", "keep_id", "copies").repartitionById(owners, owner).sortWithinPartitions("bucket", "h")
    index = owned.mapInArrow(
        _own, "bucket int, h long, chain int, text_sha256 string, keep_id long, group_size long"
    )
    return stored(index, "exact-index")


def dedup(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, text_key.

    Null text counts as empty, and all empty texts are one group.  Texts that differ only in
    white space are equal.  Of equal texts the smallest doc_id stays; rows that repeat a doc_id
    count one each in group_size, and each is kept or dropped by its own text.  text_key is a hash of the text
    as it is.  Empty table: no rows.  Columns other than doc_id and text are not read.
    """
    own = text_key(F.col("text")).alias("text_key")
    keyed = docs.select("doc_id", own, one_space(F.col("text")).alias("norm")).withColumn("h", F.xxhash64("norm"))
    find, buckets = find_bucket(keyed, capacity, max_depth)
    index = build_index(keyed, find, buckets).select("bucket", "h", "text_sha256", "keep_id", "group_size")
    probes = find(keyed.select("doc_id", "text_key", "h", F.sha2("norm", 256).alias("text_sha256")))
    return probes.join(index, ["bucket", "h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256", "text_key"
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("text_key")


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {
    "op6_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
}
