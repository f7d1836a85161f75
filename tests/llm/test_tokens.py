import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noticelake.llm import packing, tokenfile
from noticelake.llm.tokens import WordTokenizer, default_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def plain(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], np.uint32)


TEXTS = [
    "",
    " \t ",
    "It's NOT,ok.. a.,b 12.5 don'T <|endoftext|> x<|ENDOFTEXT|>y <|startoftext|>.",
    "Éa É, ΟΔΥΣΣΕΥΣ. İstanbul x y ﬁn ́a,\x0bb\x1cc",
    "日本語 テスト, 🙂🙂. a‍b",
]


def test_word_cache_is_exact(library, documents):
    words = WordTokenizer(default_path(), kept=50)
    texts = TEXTS + [t for _, t in documents]
    for text, ids in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
        assert np.array_equal(ids, plain(library, text)), text[:80]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(blacklist_categories=("Cs",)), max_size=40))
def test_word_cache_on_any_text(library_text):
    words = _words()
    assert np.array_equal(next(words[0].encode([library_text.encode()])), plain(words[1], library_text))


_HELD = []


def _words():
    if not _HELD:
        from tokenizers import Tokenizer

        _HELD.append((WordTokenizer(default_path()), Tokenizer.from_file(default_path())))
    return _HELD[0]


@given(st.lists(st.integers(0, 2**17 - 1), max_size=70), st.integers(17, 32))
def test_bits_round_trip(ids, bits):
    a = np.array(ids, np.uint32)
    data = tokenfile.pack(a, bits)
    assert len(data) == -(-len(ids) // 8) * bits
    assert np.array_equal(tokenfile.unpack(data, bits, len(ids)), a)


def test_file_random_access():
    rng = np.random.default_rng(3)
    sink = pa.BufferOutputStream()
    docs = [(7 * k, rng.integers(0, 49408, n).astype(np.uint32)) for k, n in enumerate([3, 0, 500, 17, 1000, 1])]
    w = tokenfile.Writer(sink, 49408, block=64)
    assert w.bits == 16
    for doc_id, ids in docs:
        w.add(doc_id, ids)
    w.stream, closing = _Keep(sink), sink
    w.close()
    r = tokenfile.Reader(pa.BufferReader(closing.getvalue()))
    flat = np.concatenate([x for _, x in docs])
    for a, b in ((0, len(flat)), (63, 65), (100, 100), (5, 1400), (len(flat) - 1, len(flat))):
        assert np.array_equal(r.ids(a, b), flat[a:b])
    got = list(r.documents(ahead=50))
    assert [g[0] for g in got] == [d for d, _ in docs]
    assert all(np.array_equal(g[2], x) for g, (_, x) in zip(got, docs, strict=True))


class _Keep:
    def __init__(self, sink):
        self.sink = sink

    def write(self, data):
        self.sink.write(data)

    def close(self):
        pass


def test_token_file_query(spark, sf, documents, library):
    want, start = [], 0
    for doc_id, text in sorted(documents):
        ids = plain(library, text)
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.op7_token_file(spark, sf).collect())
    assert got == want


def test_token_file_odd_rows(spark, odd, none, tmp_path):
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokenfile.read_digests(tokenfile.write_tokens(odd, f"file://{tmp_path}/a", default_path())).collect())
    assert [g[1] for g in got] == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))
    assert got[0] == (0, 1, 1)
    empty = tokenfile.read_digests(tokenfile.write_tokens(none, f"file://{tmp_path}/b", default_path()))
    assert empty.collect() == []


def check_packing(rows, pieces, library, size):
    ids = defaultdict(list)
    for doc_id, text in rows:
        ids[doc_id].append(plain(library, text))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for doc_id, own in by_doc.items():
        if len(ids[doc_id]) > 1:
            continue
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[doc_id][0])
            part = ids[doc_id][0][p.start : p.start + p.length]
            assert zlib.crc32(part.tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids[doc_id][0])
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size and at & (at - 1) == 0  # nothing to pad
    assert sum(p.length for p in pieces) == sum(len(x) for v in ids.values() for x in v)


def test_packing_query(spark, sf, documents, library):
    check_packing(documents, packing.op9_packing(spark, sf).collect(), library, 2048)


def test_packing_odd_rows(odd, none, library):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check_packing(rows, packing.pack_documents(odd, default_path(), 64, 3).collect(), library, 64)
    assert packing.pack_documents(none, default_path()).collect() == []


def test_assign_balances_cost():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 600, 400).tolist()
    pieces = packing.assign(lengths, 1024)
    n_full = sum(lengths) // 1024
    cost = [0.0] * n_full
    for _, _, n, s, _ in pieces:
        if s < n_full:
            cost[s] += n + packing.QUADRATIC * n * n
    assert max(cost) <= 1.1 * min(cost)
    assert len(pieces) - len(lengths) <= n_full + 10


def test_rows_that_repeat_an_id_or_have_none(spark, tmp_path):
    """They spread over shards and files, each is whole once, and a second run gives the same."""
    from noticelake.llm import packing, tokenfile
    from noticelake.llm.tokens import default_path

    rows = [(7, f"word {i} and {'more ' * (i % 9)}") for i in range(300)] + [(None, "no id"), (None, None), (7, "word 1 and more "), (8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed = packing.pack_documents(docs, default_path(), docs_in_shard=64)
    found = packed.collect()
    shards = {}
    for r in found:
        shards.setdefault(r["sequence_id"] >> 32, []).append(r)
    assert len(shards) > 3 and max(len(x) for x in shards.values()) < 150
    encoded = tokenfile.read_digests(tokenfile.write_tokens(docs, f"file://{tmp_path}/t", default_path())).collect()
    assert sum(r["length"] for r in found) == sum(r["n_tokens"] for r in encoded) and len(encoded) == len(rows)
    ids = [r["doc_id"] for r in sorted(encoded, key=lambda r: r["start"])]
    assert ids == [None, None] + [7] * 301 + [8]
    again = tokenfile.read_digests(tokenfile.write_tokens(docs.repartition(2), f"file://{tmp_path}/u", default_path())).collect()
    assert sorted(map(str, again)) == sorted(map(str, encoded))
