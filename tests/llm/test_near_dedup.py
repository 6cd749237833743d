import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from namesake.llm import _bytes as B
from namesake.llm._components import components
from namesake.llm._superminhash import signatures
from namesake.llm.near_dedup import near_duplicates, op10_near_dedup

from .conftest import SCHEMA, odd_rows, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows):
    """doc_id -> (set size, component, kept) by holding every text against every other."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= 75 * max(len(x), len(y)):
            n = len(x & y)
            if 100 * n >= 75 * (len(x) + len(y) - n):
                a, b = sorted((find(a), find(b)))
                parent[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect() if r.doc_id is not None}


def test_whole_table_matches_brute_force(spark, small_docs):
    result = op10_near_dedup(spark, "/root/testdata/sf0.001").collect()
    assert len(result) == len(small_docs)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in result} == brute([(i, t) for i, t, *_ in small_docs])


def test_odd_rows(odd):
    result = near_duplicates(odd).collect()
    assert len(result) == len(odd_rows())
    assert got(near_duplicates(odd)) == brute([(r[0], r[1]) for r in odd_rows()])
    none = {(r.n_shingles, r.component_id, r.kept) for r in result if r.doc_id is None}
    assert (0, None, True) in none and any(c == 3 and not k for _, c, k in none)


def test_empty_table(empty):
    assert near_duplicates(empty).count() == 0


def test_group_of_edited_copies_chains_and_borders(spark):
    """Edits around the limit of 0.75, so that links run through some copies and not others."""
    base = words(120, 1).split()
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            w[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(w), "en", "s", 1))
    found = got(near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    expected = brute([(r[0], r[1]) for r in rows])
    assert found == expected
    assert len({v[1] for v in expected.values()}) > 3


def test_signature_estimates_similarity_and_is_unbiased():
    rng = np.random.default_rng(0)
    pool = B.mix(np.arange(1, 401, dtype=np.uint64))
    a, b = pool[:300], pool[100:]
    sig = signatures([a, b], 128)
    assert abs(np.mean(sig[0] == sig[1]) - 0.5) < 0.15
    assert (signatures([rng.permutation(a)], 128) == sig[0]).all()
    tiny = signatures([pool[:1]], 16)[0] >> 24
    assert sorted(tiny.tolist()) == list(range(16))  # one element fills every slot with one rank each


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (7, 7), (30, 29), (29, 28), (28, 27), (27, 26)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 26: 26, 27: 26, 28: 26, 29: 26, 30: 26}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chain_of_a_thousand(spark):
    links = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(links).agg(F.max("label"), F.count("*")).first() == (0, 1001)
