import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from namesake.llm import _pretokens, token_records
from namesake.llm._store import new_path
from namesake.llm.bpe import TrieEncoder, _loaded, encode_documents, op8_bpe
from namesake.llm.token_records import frame, masked, op3_token_records, parsed, read_shard, read_token_records, record, unframe, write_token_records

from .conftest import odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def bpe_rows(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_bpe_of_whole_table_is_the_librarys(spark, small_docs, library):
    found = sorted((tuple(r) for r in op8_bpe(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert found == bpe_rows(library, [r[:2] for r in small_docs])


def test_bpe_of_odd_rows(odd, empty, library):
    found = sorted((tuple(r) for r in encode_documents(odd, PATH).collect()), key=repr)
    assert found == bpe_rows(library, [r[:2] for r in odd_rows()])
    assert encode_documents(empty, PATH).count() == 0


def test_hostile_texts(library):
    texts = ["<|endoftext|>a <|endoftext|><|endoftext|>", " " * 500, "'s 'S we'll", "a\x00b\x1c\x85\u2028 ՘", "aaaa" * 300, "\U0001f469‍\U0001f467 ༺", "\n\n \t x", "0123456789" * 30, "ﬁ Ⅷ ½ ᾳ", ""]
    encoder, table = _loaded(PATH)
    codes = [c for _, run in table.encoded(pa.array(texts)) for c in run]
    for text, code in zip(texts, codes, strict=True):
        ids = np.frombuffer(code, "<u4")
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert encoder.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_trie_is_independent_of_batches(library):
    words = [" the", " then", " them", "theme", " thematic", "antidis", "antidisestablishment", " 1234", "zzzzqqq"]
    encoder = TrieEncoder(PATH)
    together = encoder.encode(words)
    assert together == [encoder.encode([w])[0] for w in words]
    assert [np.frombuffer(c, "<u4").tolist() for c in together] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_usual_characters_split_as_in_the_library(library):
    for cp in [*range(1, 0x530), *range(0x2010, 0x2061), *range(0x20A0, 0x20C0), *range(0x3041, 0x3097), *range(0x4E00, 0x4F00), *range(0xAC00, 0xAD00)]:
        c = chr(cp)
        if not _pretokens._UNUSUAL.search(c):
            text = f"a{c}b 1{c} {c}{c}  x"
            assert _pretokens._SPLIT.findall(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(cp)


def record_rows(library, rows):
    out, at = [], 0
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_records_of_whole_table(spark, small_docs, library):
    found = sorted(tuple(r) for r in op3_token_records(spark, "/root/testdata/sf0.001").collect())
    assert found == record_rows(library, sorted(r[:2] for r in small_docs))


def test_records_of_odd_rows(spark, odd, empty, library):
    found = [tuple(r) for r in read_token_records(write_token_records(odd, PATH, new_path(spark, "t"))).collect()]
    assert sorted(f[1] for f in found) == sorted({f[1] for f in found}) and min(f[1] for f in found) == 0
    assert sorted((repr(f[0]), f[2], f[3]) for f in found) == sorted((repr(r[0]), r[2], r[3]) for r in record_rows(library, [r[:2] for r in odd_rows()]))
    by_start = sorted(found, key=lambda f: f[1])
    ids = [f[0] for f in by_start]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert read_token_records(write_token_records(empty, PATH, new_path(spark, "t"))).count() == 0


def test_shuffled_reads_by_the_index(spark, odd):
    for row in write_token_records(odd, PATH, new_path(spark, "t"), shards=2).collect():
        straight = list(read_shard(row.path, row.index_path))
        assert len(straight) == row.records
        order = list(range(row.records))[::-1]
        back = list(read_shard(row.path, row.index_path, order))
        assert [(i, x.tolist()) for i, x in back] == [(i, x.tolist()) for i, x in straight][::-1]


def test_frames_detect_damage():
    data = record(7, np.array([1, 2, 50256], "<u4"), 2)
    payload, end = unframe(data)
    assert end == len(data) and parsed(payload)[0] == 7 and parsed(payload)[1].tolist() == [1, 2, 50256]
    assert parsed(unframe(record(None, np.zeros(0, "<u4"), 4))[0])[0] is None
    for k in range(len(data)):
        broken = data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :]
        with pytest.raises(ValueError):
            unframe(broken)
    with pytest.raises(ValueError):
        unframe(data[:-1])
    assert frame(b"") == struct.pack("<QI", 0, masked(bytes(8))) + struct.pack("<I", masked(b""))
    assert token_records.MASK == 0xA282EAD8


def test_places_at_once_are_the_patterns_pieces():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    part = st.text(alphabet="'stmdrevlx  \n\t\xa0  12é-.中　ÅǄ́·", max_size=25)

    @settings(max_examples=600, deadline=None)
    @given(st.lists(part, min_size=1, max_size=5))
    def check(texts):
        texts = [t for t in texts if not _pretokens._UNUSUAL.search(t)]
        whole = "".join(texts)
        begins = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        starts = _pretokens.piece_starts(np.frombuffer(whole.encode("utf-32-le"), np.uint32), begins).tolist()
        assert [whole[a:b] for a, b in zip(starts, [*starts[1:], len(whole)][: len(starts)], strict=True)] == [p for t in texts for p in _pretokens._SPLIT.findall(t)]

    check()


def test_random_texts_are_the_librarys(library):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("'stmdrevl ab  \n\t1é-.中\U0001f600͸<|endoftext|>") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["<|endoftext|>", "x<|endoftext|>'s", None]
    codes = [c for _, run in _loaded(PATH)[1].encoded(pa.array(texts)) for c in run]
    assert [np.frombuffer(c, "<u4").tolist() for c in codes] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    from namesake.llm._pretokens import PieceTable

    again = [c for _, run in PieceTable(PATH).encoded(pa.array(texts)) for c in run]
    assert again == codes
