"""Pairs made tile by tile against the operators that join them one by one."""

import random

import numpy as np
import pytest

from namesake.operators import blocking, distance, features, tiles
from namesake.plans import workflow


@pytest.fixture(scope="module")
def tables(spark):
    """Two large blocks and small ones, repeated rows, nulls, missing kinds, articles with several signatures and shared blocks."""
    rng = random.Random(4)
    names = ["Alpha", "Alfa", "Beta", "Gamma", "Delta"]
    signatures = [(i, k, rng.choice(names[:2] * 4 + names), rng.choice(["A", "B", None]), rng.choice(["C", None])) for i in range(60) for k in range(rng.randint(1, 3))]
    signatures += [signatures[0], (70, 0, "Alone", "A", None), (None, 1, "Alpha", "A", None), (71, None, "Alpha", "A", None), (72, 0, None, None, None)]
    s = spark.createDataFrame(signatures, "id long, d int, last_name string, fn_initial string, mn_initial string")
    s = blocking.with_block_key(s, 8).repartition(3)
    articles = spark.createDataFrame([(i, rng.choice([1990, 2001, None]), i % 5) for i in [*range(58), 3]], "id long, year int, processid long")
    topics = spark.createDataFrame([(i, rng.choice([1, 2, None])) for i in [*range(60), 7]], "id long, topic int")
    tokens = [(kind, i, rng.choice("uvwxyz"), rng.randint(1, 3)) for i in range(60) for kind in distance.KINDS for _ in range(rng.randint(0, 4))]
    counts = spark.createDataFrame(sorted({t[:3]: t for t in tokens}.values()), "kind string, id long, token string, n long")
    classes = spark.createDataFrame([("Alpha", "Alfa", 0.25), ("Alfa", "Alpha", 0.5), ("Alpha", "Alpha", None), ("Beta", "Beta", 0.125)], "last_name_1 string, last_name_2 string, dist double")
    return s, articles, topics, counts, classes


def test_common_counts_are_set_intersections(monkeypatch):
    rng = np.random.default_rng(1)
    for dense in (0, 4, 1 << 40):
        monkeypatch.setattr(tiles, "DENSE", dense)
        monkeypatch.setattr(tiles, "_WIDTH", 7)
        monkeypatch.setattr(tiles, "_SLAB", 50)
        sets = [[set(rng.integers(0, 40, rng.integers(0, 30)).tolist()) for _ in range(n)] for n in (9, 13)]
        flat = [(np.repeat(np.arange(len(side)), [len(x) for x in side]), np.array([v for x in side for v in x], np.int64)) for side in sets]
        found = tiles.common_counts(9, *flat[0], 13, *flat[1])
        assert found.tolist() == [[len(x & y) for y in sets[1]] for x in sets[0]]


@pytest.mark.parametrize("side", [4, 512])
def test_features_are_those_of_joined_pairs(tables, monkeypatch, side):
    s, articles, topics, counts, classes = tables
    monkeypatch.setattr(tiles, "SIDE", side)
    monkeypatch.setattr(tiles, "ROWS", 64)
    some = articles.filter("processid = 2").select("id")
    for batch, given in ((None, None), (None, classes), (some, None), (some, classes)):
        pairs = blocking.candidate_pairs(s if batch is None else s.join(batch, "id", "left_semi"), s)
        near = distance.wide(distance.multiset_jaccard(counts, blocking.article_pairs(pairs)))
        want = features.pair_features(pairs, s, articles, topics, near, given)
        found = tiles.block_features(batch, s, articles, topics, counts, given)
        assert found.dtypes == want.dtypes
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("side", [4, 512])
def test_distances_are_those_of_joined_pairs(tables, monkeypatch, side):
    s, _, _, counts, _ = tables
    monkeypatch.setattr(tiles, "SIDE", side)
    pairs = blocking.article_pairs(blocking.candidate_pairs(s, s))
    want = {(r.id1, r.id2, r.kind): r.dist for r in distance.multiset_jaccard(counts, pairs).collect()}
    rows = tiles.article_distances(s, counts).collect()
    assert len(rows) == len({(r.id1, r.id2) for r in rows}) == pairs.count()
    assert {(r.id1, r.id2, k): r[f"dist_{k}"] for r in rows for k in distance.KINDS if r[f"dist_{k}"] is not None} == want


def test_class_distances_of_blocks_are_those_of_pairs(spark, tables):
    s = tables[0]
    vectors = spark.createDataFrame([("Alpha", 1, 0), ("Alfa", 1, 1), ("Beta", 0, 1), ("Alone", 1, 1)], "last_name string, x int, y int")
    want = distance.class_distances(blocking.candidate_pairs(s, s), s, vectors, ("x", "y"))
    assert sorted(distance.block_class_distances(s, vectors, ("x", "y")).collect()) == sorted(want.collect())


def test_results_by_article_and_their_counts(spark):
    same = spark.createDataFrame([(1, 0, 2, 0, True), (1, 2, 2, 1, True), (1, 0, 3, 0, True), (1, 0, 4, 0, False), (9, 0, 1, 0, True)], "id1 long, d1 int, id2 long, d2 int, same boolean")
    signatures = spark.createDataFrame([(2, 0, "x"), (2, 0, "y"), (5, 0, "z")], "id long, d int, author string")
    articles = spark.createDataFrame([(1, 7, "a", "10.1"), (2, 7, "b", "10.2"), (2, 8, "c", "10.2"), (9, 8, "e", "10.9")], "id long, processid long, title string, doi string")
    found = workflow.results(same, signatures, articles, None, limit=None)
    want = [(7, 0, t, "10.2", a) for t in "bc" for a in "xy"] + [(7, 2, t, "10.2", None) for t in "bc"] + [(7, 0, None, None, None), (8, 0, "a", "10.1", None)]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert sorted(map(tuple, workflow.result_counts(found).collect())) == [(7, 0, 5), (7, 1, 0), (7, 2, 2), (8, 0, 1)]
    lists = {(r.processid, r.d1): len(r.related) for r in workflow.grouped_results(found).collect()}
    assert lists == {(r.processid, r.d1): r.n_related for r in workflow.result_counts(found).collect()}
