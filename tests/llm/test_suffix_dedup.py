import hashlib
import random
from collections import Counter

import numpy as np

from namesake.llm import _bytes as B
from namesake.llm import suffix_dedup as S
from namesake.llm.suffix_dedup import cut_repeats, op9_suffix_dedup

from .conftest import SCHEMA, odd_rows, words


def brute(texts, depth=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + depth] for b in raw for i in range(len(b) - depth + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if count[b[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len([r for r in bytes(gone).split(b"\0") if r]), hashlib.sha256(kept).hexdigest()))
    return out


def rows(df):
    return sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_whole_table_matches_brute_force(spark, small_docs):
    found = {r.doc_id: tuple(r)[1:] for r in op9_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert found == dict(zip([r[0] for r in small_docs], brute([r[1] for r in small_docs]), strict=True))


def test_odd_rows_and_long_texts_in_pieces(odd, monkeypatch):
    texts = [r[1] for r in odd_rows()]
    assert len(texts[-1]) > 2 * B.CHUNK / 2
    assert rows(cut_repeats(odd)) == sorted(brute(texts))


def covered(chunk):
    """Every window: place, anchor and first digit."""
    text, at, low, high = chunk.runs()
    unit, group = chunk.units(text, at, low, high, None)[1:3]
    return [((u >> 16) - a, u >> 16, g) for u, g in zip(unit.tolist(), group.tolist(), strict=True) for a in range(u >> 8 & 255, (u & 255) + 1)]


def test_pieces_of_a_long_text_agree_with_the_whole(monkeypatch):
    text = (words(4000, 1) + " ") * 2 + words(30_000, 2)
    whole = covered(S._Chunk([text.encode()], 200, 48))
    assert sorted(w[0] for w in whole) == list(range(len(text) - 199))
    monkeypatch.setattr(B, "CHUNK", 20_000)
    assert sorted(w for _, _, piece in S._pieces([text.encode()], 200, 48) for w in covered(piece)) == sorted(whole)


def test_common_digits_are_sorted_in_narrower_runs(spark, odd):
    """With two runs to a task, most digits take all passes."""
    rng = random.Random(3)
    shared = [words(40, 90 + k)[:210] for k in range(4)]
    texts = [words(20, 200 + i) + rng.choice(shared)[: rng.randint(150, 210)] + words(20, 300 + i) for i in range(60)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    assert rows(cut_repeats(df, together=2)) == rows(cut_repeats(df)) == sorted(brute(texts))
    assert rows(cut_repeats(odd, together=2)) == sorted(brute([r[1] for r in odd_rows()]))


def test_digit_passes_are_brute_force():
    rng = random.Random(5)
    for trial in range(30):
        depth = rng.choice([20, 37, 64])
        anchor = "".join(rng.choice("xyz") for _ in range(6))
        gid, low, high, runs = [], [], [], []
        for _ in range(25):
            hi = rng.randint(0, depth - 6)
            lo = rng.randint(0, hi)
            left, right = "".join(rng.choice("ab") if rng.random() < 0.1 else "a" for _ in range(hi)), "".join(rng.choice("ab") if rng.random() < 0.1 else "a" for _ in range(depth - lo - 6))
            gid.append(rng.randint(0, 2)), low.append(lo), high.append(hi), runs.append((left + anchor + right).encode())
        windows = [(g, a, r[hi - a : hi - a + depth], k) for k, (g, lo, hi, r) in enumerate(zip(gid, low, high, runs, strict=True)) for a in range(lo, hi + 1)]
        times = Counter(w[:3] for w in windows)
        run, a = S.repeated_windows(np.array(gid), np.array(low), np.array(high), runs, depth)
        assert sorted(zip(run.tolist(), a.tolist(), strict=True)) == sorted((w[3], w[1]) for w in windows if times[w[:3]] > 1), trial


def test_empty_table(empty):
    assert cut_repeats(empty).count() == 0


def test_borders_and_overlaps(spark):
    p = words(60, 5)[:260]
    texts = [p[:199], p[:200] + "A" + p[:200], "B" + p[5:210], p[30:250] + "C", "z" * 201, "q" * 200, "ab" * 100 + "c" + "ab" * 100, p[100:] + p[:100], "é" * 120]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: tuple(r)[1:] for r in cut_repeats(df).collect()}
    assert found == dict(enumerate(brute(texts)))


def test_kept_text_is_whole_characters(spark):
    p = "é" * 130
    df = spark.createDataFrame([(1, p + "end", "en", "s", 1), (2, "x" + p, "fr", "t", 1), (3, "clean", None, None, 1)], SCHEMA)
    found = {r.doc_id: (r.kept_text, r.lang) for r in cut_repeats(df, with_text=True, carry=("lang",)).collect()}
    assert found == {1: ("end", "en"), 2: ("x", "fr"), 3: ("clean", None)}


def test_least_doc_id_is_not_a_missing_one(spark):
    p = words(60, 5)[:260]
    least = -(1 << 63)
    ids, texts = [least, None, None, 0, least], [p, p, words(50, 7), None, "x" + p]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)], SCHEMA)
    found = [tuple(r) for r in cut_repeats(df).collect()]
    assert sorted(found, key=repr) == sorted(((i, *b) for i, b in zip(ids, brute(texts), strict=True)), key=repr)


def test_orders_tie_alike_in_chunks_of_any_length(monkeypatch):
    """Where grams differ in the last bits of their order only, the anchor does not depend on what else the chunk holds."""
    text = words(60, 5)[:260].encode()
    monkeypatch.setattr(S, "_order", lambda buf, gram: np.uint64(1 << 63) + (np.arange(len(buf) - gram + 1, dtype=np.uint64)[::-1] % np.uint64(64)))
    alone = {(w[0], w[1]) for w in covered(S._Chunk([text], 200, 48))}
    beside = {(w[0], w[1]) for w in covered(S._Chunk([text, b"y" * 64 * 4096], 200, 48)) if w[0] <= len(text) - 200}
    assert alone == beside


def test_a_copy_in_another_batch_does_not_stop_a_run(spark):
    """Copies that meet no other run of their digits may stand for one that does; the partial repeat is found all the same."""
    whole = [words(60, 400 + k)[:230] for k in range(8)]
    copies = [(10 * n + k, p) for n in range(1, 5) for k, p in enumerate(whole)]
    here = [x for k, p in enumerate(whole) for x in ((k, p), (100 + k, "B" + p[10:220] + "C"))]
    parts = [copies[:8], copies[8:16], here, copies[16:24], copies[24:]]
    rows_ = [r for part in parts for r in part]
    df = spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)).flatMap(lambda part: [(i, t, None, None, None) for i, t in part]), SCHEMA)
    found = {r.doc_id: tuple(r)[1:] for r in cut_repeats(df).collect()}
    assert found == dict(zip([i for i, _ in rows_], brute([t for _, t in rows_]), strict=True))
