"""Texts made to collide under hashes that are sums of powers: the Thue-Morse word over two letters, and its complement."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from namesake.llm import _bytes as B
from namesake.llm import _pretokens
from namesake.llm._store import new_path
from namesake.llm.bpe import encode_documents
from namesake.llm.near_dedup import near_duplicates
from namesake.llm.quality import judge
from namesake.llm.suffix_dedup import cut_repeats
from namesake.llm.token_records import read_token_records, write_token_records

from .conftest import SCHEMA
from .test_suffix_dedup import brute
from .test_text_operators import counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIZES = (512, 1024, 2048, 4096, 8192)


def morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def twins():
    """Words, words within words, lines and whole texts that differ in every letter."""
    texts = []
    for n in SIZES:
        a, b = morse(n), morse(n, "ba")
        texts += [a, b, f"{a}\n{b}", f"x{a} y{b}", f"{a} {b} {a}", f"{a} one two {b} one two", f"{b} {a} {b}"]
        texts += [f"{morse(n, ' c')}.", f"{morse(n, 'c ')}."]
    return texts


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(twins())], SCHEMA).coalesce(1)


def test_spans_of_equal_length_differ():
    for n in SIZES:
        a, b = morse(n).encode(), morse(n, "ba").encode()
        buf = np.frombuffer(a + b + a, np.uint8)
        h = B.span_hash(buf, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
        assert h[0] == h[2] != h[1]


def test_classes_compare_bytes_where_hashes_agree(monkeypatch):
    monkeypatch.setattr(B, "span_hash", lambda buf, start, end: np.zeros(len(start), np.uint64))
    buf = np.frombuffer(b"ab cd ab ce", np.uint8)
    found = B.classes(buf, np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11]))
    assert found[0] == found[2] and len(set(found.tolist())) == 3


def test_pieces_are_split_anew_where_hashes_agree(monkeypatch):
    library = Tokenizer.from_file(PATH)
    monkeypatch.setattr(_pretokens, "span_hash", lambda buf, start, end: np.zeros(len(start), np.uint64))
    import pyarrow as pa

    texts = ["one two three", "six ten", ""]
    found = [c for _, codes in _pretokens.PieceTable(PATH).encoded(pa.array(texts)) for c in codes]
    assert found == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_tokens(spark, table):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4") for t in twins()]
    found = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in encode_documents(table, PATH).collect()}
    assert found == {i: (len(w), hashlib.sha256(w.tobytes()).hexdigest()) for i, w in enumerate(want)}
    read = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in read_token_records(write_token_records(table, PATH, new_path(spark, "t"))).collect()}
    assert read == {i: (len(w) + 1, zlib.crc32(w.tobytes() + bytes(4))) for i, w in enumerate(want)}


def test_counts(table):
    found = {r.doc_id: tuple(r)[1:7] for r in judge(table).collect()}
    assert found == {i: counts(t) for i, t in enumerate(twins())}


def test_near_duplicates(table):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table).collect()}
    texts = twins()
    assert len({found[texts.index(morse(n, x))][1] for n in SIZES for x in ("ab", "ba")}) == 2 * len(SIZES)
    assert all(found[k][0] == 1 for k in (0, 1))
    from .test_near_dedup import brute as groups

    assert found == {i: g[:2] for i, g in groups(list(enumerate(texts))).items()}


def test_repeats(table):
    found = {r.doc_id: tuple(r)[1:] for r in cut_repeats(table).collect()}
    assert found == dict(enumerate(brute(twins())))
