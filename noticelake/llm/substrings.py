"""Substring dedup with suffix automata of reference shards.

A window is ``width`` words in a row.  A word goes if some window over it also starts in a
document with a smaller doc_id.  Laying every document against every shard of the corpus would
be quadratic, so shards are cut by content and a document is streamed through those only that
can match:

1. Of every window the anchor is the ANCHOR-word gram with the smallest hash; windows in a row
   with one anchor make a segment.  Equal windows have equal anchors, wherever they stand.
2. Anchors that stand in one document only can't match; segments of the others remain.  Where all
   segments of an anchor are equal, the first of them is the reference and all that would be
   streamed, so its document has every window.  An anchor with over HOT segments of several kinds would
   outgrow its shard, so each of its windows becomes a segment of its own, with its own hash as anchor.
3. A shard owns a set of anchors.  Their segments come in the order of doc_id, each distinct one once.
   A segment is streamed through the suffix automaton of what came before: the matching statistics
   (longest match that ends at each word, by suffix links where a word does not follow) reach
   ``width`` at the end of each window that stands in an earlier reference, and the state knows the
   first document that has it.  Only a segment with a window that is new joins the automaton.
4. Documents pick up the runs of windows found for their segments, as maximal spans of words, and
   drop the covered words.

The automaton of a shard meets its documents by the shuffle, not by a broadcast: the references
grow with the corpus, and sending all automata to all documents is quadratic.

Words are compared by 64-bit hashes that numpy takes over the bytes of a whole batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, ranges, short_batches, stored, table, utf8

WIDTH, ANCHOR = 13, 5
#: Segments of a shard, about; segments beyond which an anchor's windows go one by one; rows that a
#: task folds before it passes them on.
SHARD, HOT, FOLD = 8192, 20_000, 100_000
#: Anchors at a time in the sliding minimum, and bytes hashed at a time; they bound memory.
BLOCK, BYTES = 1 << 20, 1 << 20

_random = np.random.RandomState(13)
_BYTE, _PLACE, _FAR = (_random.randint(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (256, 4096, 4096))
_BASES = [int(x) * 8 + 5 for x in _random.randint(1 << 50, 1 << 60, 2)]
_FAR[0] = 1  # so that only letters beyond the 4096th read it
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and how many each text has; null has none."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    borders = ends[:-1][ends[:-1] < ends[1:]]
    first[borders] = ~space[borders]
    at = np.flatnonzero(first)
    sizes = np.diff(np.searchsorted(at, ends))
    found = np.empty(len(at), np.uint64)
    k = 0
    while k < len(at):  # whole words, about BYTES at a time
        stop = max(k + 1, int(np.searchsorted(at, at[k] + BYTES)))
        a, b = at[k], at[stop] if stop < len(at) else len(data)
        own = at[k:stop] - a
        place = np.arange(b - a) - np.repeat(own, np.diff(np.append(own, b - a)))
        value = _BYTE[data[a:b]] * _PLACE[place & 4095]
        if place.max() > 4095:
            value *= _FAR[place >> 12 & 4095]
        value[space[a:b]] = 0
        found[k:stop] = np.add.reduceat(value, own)
        k = stop
    return _mix(found), sizes


def segments(words: np.ndarray, sizes: np.ndarray, width: int = WIDTH, k: int = ANCHOR):
    """Segments of documents whose word hashes stand one after another.

    Returns arrays: document, first word in it, number of windows, hash of the anchor.
    """
    none = np.zeros(0, np.int64)
    if len(words) < width:
        return none, none, none, none.astype(np.uint64)
    grams = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j]
    grams = _mix(grams)
    span, n = width - k + 1, len(words) - width + 1
    anchor = np.empty(n, np.int64)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        seen = np.lib.stride_tricks.sliding_window_view(grams[a : b + span - 1], span)
        anchor[a:b] = seen.argmin(1) + np.arange(a, b)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)[:n]
    fits = np.arange(n) + width <= ends[doc]
    new = fits.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~fits[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return none, none, none, none.astype(np.uint64)
    count = np.add.reduceat(fits.astype(np.int64), first)
    owner = doc[first]
    return owner, first - (ends - sizes)[owner], count, grams[anchor[first]]


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base % (1 << 64), np.uint64)
        known[0] = 1
        known = np.cumprod(known)
        if n <= BLOCK:
            _POWERS[base] = known
    return known[:n]


def keys(words: np.ndarray, start: np.ndarray, length: np.ndarray, base: int) -> np.ndarray:
    """64-bit keys of the word sequences at ``start``: polynomials in ``base``, from one running sum."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(base, len(words)), out=total[1:])
    back = _powers(pow(base, -1, 1 << 64), len(words))
    return _mix((total[start + length] - total[start]) * back[start] + length.astype(np.uint64)).view(np.int64)


def _anchors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, doc_id and the key of the whole segment."""
    for b in it:
        words, sizes = word_hashes(b[1])
        doc, start, count, anchor = segments(words, sizes)
        whole = keys(words, (np.cumsum(sizes) - sizes)[doc] + start, count + WIDTH - 1, _BASES[0])
        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), b[0].take(pa.array(doc)), pa.array(whole)], names=["anchor", "doc_id", "whole"])


def _segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        doc, start, count, anchor = segments(*word_hashes(b[2]))
        at = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), b[0].take(at), b[1].take(at), pa.array(start << 8 | count)],
            names=["anchor", "doc_id", "text_key", "place"],
        )


_CUT = pa.schema(
    [
        ("anchor", pa.int64()),
        ("k1", pa.int64()),
        ("k2", pa.int64()),
        ("words", pa.list_(pa.int64())),
        ("doc_id", pa.int64()),
        ("text_key", pa.int64()),
        ("start", pa.int64()),
    ]
)


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two kinds of rows: places (no words), and distinct word sequences of segments with their smallest doc_id."""
    held: list[tuple] = []
    for b in it:
        words, sizes = word_hashes(b[2])
        own, spots = b[3].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), b[3].flatten()
        place, anchor, hot = (x.to_numpy(zero_copy_only=False) for x in spots.flatten())
        doc = np.repeat(np.arange(len(own)), own)
        start, count = place >> 8, place & 255
        times = np.where(hot, count, 1)  # a window at a time
        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        doc, anchor, hot = np.repeat(doc, times), np.repeat(anchor, times), np.repeat(hot, times)
        start = np.repeat(start, times) + step
        length = np.where(hot, 1, np.repeat(count, times)) + WIDTH - 1
        if not len(doc):
            continue
        first = (np.cumsum(sizes) - sizes)[doc] + start
        k1, k2 = (keys(words, first, length, base) for base in _BASES)
        flat = words[ranges(first, length)]
        anchor = np.where(hot, k1, anchor)
        at, none = pa.array(doc), lambda kind, n=len(doc): pa.nulls(n, kind)
        ids = b[0].take(at)
        yield pa.RecordBatch.from_arrays([none(pa.int64()), pa.array(k1), pa.array(k2), none(_CUT[3].type), ids, b[1].take(at), pa.array(start)], schema=_CUT)
        held.append((anchor, k1, k2, ids.to_numpy(zero_copy_only=False), length, flat))
        if sum(len(x[0]) for x in held) > FOLD:
            yield _texts(held)
            held = []
    if held:
        yield _texts(held)


def _texts(held: list[tuple]) -> pa.RecordBatch:
    """Each distinct sequence once, with its smallest doc_id."""
    anchor, k1, k2, ids, length, flat = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((ids, k2, k1))
    new = np.append(True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1]))
    kept = order[new]
    words = flat[ranges((np.cumsum(length) - length)[kept], length[kept])].view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length[kept])).astype(np.int32)), pa.array(words))
    own = [pa.array(x[kept]) for x in (anchor, k1, k2)]
    none = pa.nulls(len(kept), pa.int64())
    return pa.RecordBatch.from_arrays([*own, lists, pa.array(ids[kept]), none, none], schema=_CUT)


class Automaton:
    """Suffix automaton of several word sequences; a state knows the first owner of its sequences.

    Sequences are added in ascending order of owner.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [0]

    def _state(self, moves: dict, link: int, length: int, owner: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.next) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """The part of state q that ends p's sequences with ``symbol``, made a state of its own."""
        moves, link, length = self.next, self.link, self.length
        part = self._state(dict(moves[q]), link[q], length[p] + 1, self.owner[q])
        while p >= 0 and moves[p].get(symbol) == q:
            moves[p][symbol] = part
            p = link[p]
        link[q] = part
        return part

    def add(self, sequence: list, owner: int) -> None:
        moves, link, length = self.next, self.link, self.length
        last = 0
        for symbol in sequence:
            q = moves[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, symbol, q)
                continue
            state = self._state({}, 0, length[last] + 1, owner)
            p = last
            while p >= 0 and symbol not in moves[p]:
                moves[p][symbol] = state
                p = link[p]
            if p >= 0:
                q = moves[p][symbol]
                link[state] = q if length[q] == length[p] + 1 else self._split(p, symbol, q)
            last = state

    def statistics(self, sequence: list, width: int) -> list[tuple[int, int | None]]:
        """For each word of any ``sequence``: how long a match ends there (no more than ``width`` is told
        apart from more), and from ``width`` on the first owner of the last ``width`` words."""
        moves, link, length, owner = self.next, self.link, self.length, self.owner
        state, matched, found = 0, 0, []
        for symbol in sequence:
            while state and symbol not in moves[state]:
                state = link[state]
                matched = length[state]
            if symbol in moves[state]:
                state = moves[state][symbol]
                matched += 1
            if matched >= width:
                # the shortest state that still holds the last ``width`` words
                while length[link[state]] >= width:
                    state = link[state]
                matched = min(matched, length[state])
                found.append((matched, owner[state]))
            else:
                found.append((matched, None))
        return found


def firsts(segments: list[tuple[int, list]], width: int = WIDTH) -> list[list[tuple[int, int, int]]]:
    """Runs (from window, to window, first owner) of each (owner, sequence), which come in ascending order of owner."""
    automaton, found = Automaton(), []
    for owner, sequence in segments:
        first = [x[1] for x in automaton.statistics(sequence, width)[width - 1 :]]
        if None in first:
            automaton.add(sequence, owner)
        runs: list[tuple[int, int, int]] = []
        for i, x in enumerate(first):
            x = owner if x is None else x
            if runs and runs[-1][2] == x:
                runs[-1] = (runs[-1][0], i + 1, x)
            else:
                runs.append((i, i + 1, x))
        found.append(runs)
    return found


_RUN = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64())])


def _shard(held: pa.Table) -> pa.Table:
    """Owner task of a shard: anchor, k1, k2, words, doc_id -> k1, k2 and the first document of each run of windows.

    Of an anchor with one segment alone, that segment is the reference and all that is streamed:
    its first document has every window.
    """
    held = held.combine_chunks()
    anchor, k1, k2, ids = (held[x].to_numpy() for x in ("anchor", "k1", "k2", "doc_id"))
    order = np.lexsort((ids, k2, k1, anchor))
    new = np.append(True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1]) | (anchor[order][1:] != anchor[order][:-1]))
    kept = order[new]
    kept = kept[np.lexsort((k2[kept], k1[kept], ids[kept], anchor[kept]))]
    words = held["words"].combine_chunks().take(pa.array(kept))
    lengths, flat = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), words.flatten().to_numpy()
    begin = np.cumsum(lengths) - lengths
    starts = np.flatnonzero(np.append(True, anchor[kept][1:] != anchor[kept][:-1]))
    sizes = np.diff(np.append(starts, len(kept)))
    alone = np.repeat(sizes == 1, sizes)
    n, ids = int(alone.sum()), ids[kept]
    a, b, first, runs = [np.zeros(n, np.int64)], [lengths[alone] - WIDTH + 1], [ids[alone]], [np.ones(n, np.int64)]
    for s, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        own = [(int(ids[i]), flat[begin[i] : begin[i] + lengths[i]].tolist()) for i in range(s, s + size)]
        found = firsts(own)
        runs.append(np.array([len(x) for x in found]))
        for column, k in ((a, 0), (b, 1), (first, 2)):
            column.append(np.array([r[k] for x in found for r in x], np.int64))
    named = kept[np.append(np.flatnonzero(alone), np.flatnonzero(~alone))]
    values = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, first)], fields=list(_RUN))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(runs))).astype(np.int32)), values)
    return pa.Table.from_arrays([pa.array(k1[named]), pa.array(k2[named]), lists], names=["k1", "k2", "runs"])


_KEPT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()),
        ("kept", pa.string()),
    ]
)


def _drop(with_text: bool):
    def drop(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in it:
                for doc_id, text, spans in zip(b[0].to_pylist(), utf8(b[1]), b[2].to_pylist(), strict=True):
                    words = text.split()
                    n, gone = len(words), 0
                    if spans:
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, [x["a"] for x in spans], 1)
                        np.add.at(edge, [x["b"] for x in spans], -1)
                        covered = np.cumsum(edge[:-1]) > 0
                        gone = int(covered.sum())
                        words = [words[i] for i in np.flatnonzero(~covered).tolist()]
                    kept = b" ".join(words)
                    yield doc_id, n, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None

        return batches(rows(), _KEPT, 512)

    return drop


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept (null without texts).

    Words stand between white space and are compared as they are.  A word goes if a window of
    WIDTH words over it also starts in a document with a smaller doc_id; windows are judged on
    the input.  Null and blank texts have no words; a text of fewer words than a window loses
    none.  Rows that share a doc_id never remove from each other.  Empty table: no rows.  Other
    columns are not read.
    """
    short_batches(docs.sparkSession, 128)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    seen = keyed.select("doc_id", "text").mapInArrow(_anchors, "anchor long, doc_id long, whole long")
    ends = seen.groupBy("anchor").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("whole").alias("low"), F.max("whole").alias("high"), F.count("*").alias("n")
    )
    several = F.col("low") != F.col("high")
    shared = stored(ends.where("first <> last").select("anchor", "first", several.alias("several"), (F.col("n") > HOT).alias("hot")), "anchors")
    cut = keyed.mapInArrow(_segments, "anchor long, doc_id long, text_key long, place long").join(shared, "anchor")
    spot = F.when(F.col("several"), F.struct("place", "anchor", "hot"))
    alone = F.when(~F.col("several"), F.struct(F.shiftright("place", 8).alias("a"), (F.shiftright("place", 8) + F.col("place").bitwiseAND(255) + WIDTH - 1).alias("b")))
    spots = cut.where("several OR first < doc_id").groupBy("doc_id", "text_key").agg(F.collect_list(spot).alias("spots"), F.collect_list(alone).alias("spans"))
    spots = stored(spots, "spots")
    parts = keyed.join(spots.where(F.size("spots") > 0), ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "spots")
    parts = stored(
        parts.mapInArrow(_cut, "anchor long, k1 long, k2 long, words array<long>, doc_id long, text_key long, start long"), "parts"
    )
    places = parts.where("words IS NULL").select("k1", "k2", "doc_id", "text_key", "start")
    contents = parts.where("words IS NOT NULL")
    shard = F.pmod("anchor", F.lit(contents.count() // SHARD + 1))
    found = contents.select(shard.alias("shard"), "anchor", "k1", "k2", "words", "doc_id").groupBy("shard").applyInArrow(
        _shard, "k1 long, k2 long, runs array<struct<a: long, b: long, first: long>>"
    )
    earlier = F.filter("runs", lambda r: r["first"] < F.col("doc_id"))
    span = F.transform(earlier, lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] + WIDTH - 1).alias("b")))
    gone = places.join(found, ["k1", "k2"]).select("doc_id", "text_key", span.alias("spans")).union(spots.select("doc_id", "text_key", "spans")).where(F.size("spans") > 0)
    gone = stored(gone.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    joined = keyed.join(gone, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_drop(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLES = {
    "op1_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM d, unnest(range(1, len(w) - 11)) t(i) WHERE len(w) >= 13
), h AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) < doc_id AS hit FROM g
), c AS (
  SELECT DISTINCT doc_id, i + k AS p FROM h, range(0, 13) r(k) WHERE hit
), p AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), k AS (
  SELECT p.doc_id, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (WHERE c.p IS NULL) AS kept
  FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY p.doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
}
