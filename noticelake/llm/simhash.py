"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits.  Two fingerprints that differ in at
most two bits either differ in at most one bit of the first segment or agree in the second
(three differing bits would be needed to break both).  So each fingerprint is looked up in
table 0 under the 33 keys of the Hamming ball of radius 1 around its first segment, and in
table 1 under its second segment alone; every hit is verified on all 64 bits.

Equal fingerprints are one entry, so the work follows the number of distinct fingerprints,
however large a group of copies is.  Components are found by joins (see components.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, stored, table, utf8
from .components import components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Shingles whose bits are counted at once; bounds memory for very long texts.
BLOCK = 1 << 16


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text: A-Z lower-cased, words between white space."""
    words = text.lower().split()  # bytes: exactly A-Z, and exactly \x20 \x09-\x0D
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    last = ends[min(width, len(words)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        spans = zip(starts[k : min(n, k + BLOCK)].tolist(), last[k : k + BLOCK].tolist(), strict=True)
        h = np.array([digest(line[i:j], SEED) for i, j in spans], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        prints = pa.array([fingerprint(x) for x in utf8(b[1])], pa.int64())
        yield pa.RecordBatch.from_arrays([b[0], prints], names=["doc_id", "fp"])


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All pairs of distinct fingerprints at ``max_bits`` or fewer (at most 2): fp, other."""
    if not 0 <= max_bits <= 2:
        raise ValueError("two segments with balls of radius 1 and 0 cover at most two bits")
    fps = prints.select("fp").distinct()
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    ball = F.transform(flips, lambda m: high.bitwiseXOR(m))
    held = F.array(
        F.struct(F.lit(0).alias("segment"), high.alias("key")), F.struct(F.lit(1).alias("segment"), low.alias("key"))
    )
    tried = F.concat(
        F.transform(ball, lambda k: F.struct(F.lit(0).alias("segment"), k.alias("key"))),
        F.array(F.struct(F.lit(1).alias("segment"), low.alias("key"))),
    )
    index = fps.select("fp", F.inline(held))
    probes = fps.select(F.col("fp").alias("other"), F.inline(tried))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits
    # Spark sizes exploded rows as if each were one still, and would broadcast the probes of 250,000 fingerprints
    return index.join(probes.hint("merge"), ["segment", "key"]).where((F.col("fp") < F.col("other")) & near).select("fp", "other").distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null, empty and blank texts have fingerprint zero and link like any other; texts of fewer
    than three words use their whole sequence.  component_id is the smallest doc_id reachable
    over links, the document included.  Repeated rows give repeated rows.  Empty table: none.
    """
    spark = docs.sparkSession
    short_batches(spark)
    prints = stored(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash")
    firsts = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    left, right = firsts.select("fp", F.col("rep").alias("a")), firsts.select(F.col("fp").alias("other"), F.col("rep").alias("b"))
    # tables that grow with the input; their packed files look smaller than their rows are in a broadcast
    edges = links(firsts, max_bits).join(left.hint("merge"), "fp").join(right.hint("merge"), "other").select("a", "b")
    labels = components(edges)
    reps = firsts.join(labels.hint("merge"), F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(reps.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash": op3_simhash}
ORACLES: dict[str, str] = {}
