"""Functions and operators of the engine on small cases, and properties."""


import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from namesake.functions.phonetic import with_metaphone
from namesake.functions.stem import stem
from namesake.functions.text import STOP_WORDS, character_bigrams, clean_field, clean_last_name, clean_whole, given_names, parse_author, soundex_number
from namesake.operators import blocking, cluster, distance, evaluate, features, scoring
from namesake.sources import ingest, schema, store


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function("v").alias("r")).first()["r"]


# Text


@pytest.mark.parametrize(("text", "tokens"), [(" a-b, C! the d ", ["", "ab", "c", "d"]), ("", []), (None, None), ("x", ["x"]), ("Don't stop", ["dont", "stop"]), ("A study of the wind", ["study", "wind"])])
def test_clean_field(spark, text, tokens):
    assert one(spark, text, clean_field) == tokens


def test_stop_words_are_complete():
    assert len(STOP_WORDS) == 174 and len(set(STOP_WORDS)) == 174


def test_whole_field_and_last_name(spark):
    assert one(spark, "Journal of the ACM", clean_whole) == "journal acm"
    assert one(spark, "de Dinéchin-O'Neil ß", clean_last_name) == "DEDINECHINONEILSS"


@pytest.mark.parametrize(("author", "parts"), [("de Dinechin BD", ("de Dinechin", "B", "D")), ("Walker J", ("Walker", "J", "")), ("Plato", ("Plato", None, None)), ("Jones J-M", ("Jones J-M", None, None)), ("  Jones   MW ", ("Jones", "M", "W"))])
def test_author(spark, author, parts):
    assert tuple(one(spark, author, parse_author)) == parts
    assert one(spark, None, parse_author) is None


def test_names(spark):
    assert one(spark, "A", character_bigrams) == ["AA"] and one(spark, "MARTIN", character_bigrams) == ["MA", "AR", "RT", "TI", "IN"] and one(spark, "ABAB", character_bigrams) == ["AB", "BA"]
    assert one(spark, "MULLER", soundex_number) == 77525448.0
    assert tuple(one(spark, "J. R.", given_names)) == ("J", "R") and tuple(one(spark, "Jo", given_names)) == ("Jo", "")


KEYS = {
    "Walker": "WLKR", "Welcker": "WLKR", "Waligora": "WLKR", "Knuth": "N0", "Xavier": "SFR", "Schwarz": "XWRS", "Church": "XRX", "Christ": "KRST", "Judge": "JJ",
    "Thumb": "0M", "Philip": "FLP", "Action": "AKXN", "Match": "MX", "Aegis": "EJS", "Whale": "WL", "Gnome": "NM", "": "", "12": "", "O'Neil": "ONL",
} | {n: "BRK" for n in "Barac Barco Barouki Berg Bergaoui Berk Birke Borgo Bourqui Brik Burk Burki".split()}


def test_metaphone(spark):
    df = spark.createDataFrame([(n,) for n in KEYS] + [(None,)], "n string")
    assert {r.n: r.k for r in with_metaphone(df, "n", "k").collect()} == KEYS | {None: None}
    short = {r.n: r.k for r in with_metaphone(df, "n", "k", 2).collect()}
    assert all(v is None or v == KEYS[n][:2] for n, v in short.items())


@pytest.mark.parametrize(("word", "root"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopeful", "hope"), ("adjustment", "adjust"), ("probate", "probat"), ("controll", "control"), ("sky", "sky"), ("is", "is"), ("generalizations", "gener")])
def test_stem(word, root):
    assert stem(word) == root


# Distances


def counts(spark, *articles):
    rows = [("title", i, t) for i, a in enumerate(articles) for t in a]
    return distance.token_counts(spark.createDataFrame(rows, "kind string, id long, token string"))


def test_distances(spark):
    c = counts(spark, "study wind".split(), "wind study survey".split(), "data mining text mining".split(), ["mining"], ["other"])
    pairs = spark.createDataFrame([(0, 1), (2, 3), (0, 4), (0, 0)], "id1 long, id2 long")
    found = {(r.id1, r.id2): r.dist for r in distance.multiset_jaccard(c, pairs).collect()}
    assert found == pytest.approx({(0, 1): 1 / 3, (2, 3): 0.75, (0, 4): 1.0, (0, 0): 0.0})


def test_distance_properties(spark):
    rng = np.random.default_rng(0)
    articles = [list(rng.choice(list("abcdef"), int(rng.integers(1, 9)))) for _ in range(12)]
    pairs = spark.createDataFrame([(i, j) for i in range(12) for j in range(12)], "id1 long, id2 long")
    found = {(r.id1, r.id2): r.dist for r in distance.multiset_jaccard(counts(spark, *articles), pairs).collect()}
    for (i, j), d in found.items():
        assert 0 <= d <= 1 and d == pytest.approx(found[j, i]) and (d == 1) == (not set(articles[i]) & set(articles[j])) and (i != j or d == 0)


@pytest.mark.parametrize(("k", "d"), [(6, 0), (5, 2 / 7), (4, 1 / 2), (3, 2 / 3), (2, 4 / 5), (1, 10 / 11), (0, 1)])
def test_class_vectors(spark, k, d):
    names = tuple("abcdef")
    struct = lambda v: F.struct(*(F.lit(x).alias(n) for n, x in zip(names, v, strict=True)))
    r = spark.range(1).select(distance.class_vector_distance(struct([1] * 6), struct([1] * k + [0] * (6 - k)), names).alias("d")).first()
    assert r.d == pytest.approx(d)


# Features and split


def test_equality_of_nulls_and_blanks(spark):
    s = spark.createDataFrame([(1, 0, "X", None, ""), (2, 0, "X", None, ""), (3, 0, "X", "A", "B"), (4, 0, "X", "A", None)], "id long, d long, last_name string, fn_initial string, mn_initial string").withColumn("focus_name", F.lit("S"))
    articles = spark.createDataFrame([(1, 1990), (2, None), (3, 2000), (4, 2001)], "id long, year int")
    topics = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, topic int")
    none = spark.createDataFrame([], "id1 long, id2 long, " + ", ".join(f"dist_{k} double" for k in distance.KINDS))
    rows = {(r.id1, r.id2): r for r in features.pair_features(blocking.candidate_pairs(s, s), s, articles, topics, none).collect()}
    assert rows.keys() == {(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i != j}  # 4 has no topic
    r = rows[1, 2]
    assert (r.eq_fn_initial, r.eq_mn_initial, r.eq_lda_topic, r.diff_year, r.dist_title, r.dist_ethnicity) == (0, 1, 1, None, 1.0, 1.0)


def test_split_counts_rows_not_keys(spark):
    found = {r.k: (r.cume, r.train) for r in features.split_by_block(spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string"), "k").collect()}
    assert found == {"a": (0.5, True), "b": (0.75, False), "c": (1.0, False)}


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.34,), (0.3399,), (None,)], "p double")
    assert [r.same for r in scoring.decided(df).collect()] == [True, False, None]


# Evaluation


def test_cluster_metrics(spark):
    df = spark.createDataFrame(list(zip("AABBC", "AABCC", strict=True)), "found string, truth string")
    assert tuple(evaluate.pairwise(df).first()) == (0.5, 0.5, 0.5)
    assert tuple(evaluate.bcubed(df).first()) == pytest.approx((0.8, 0.8, 0.8))
    alone = spark.createDataFrame([("a", "b"), ("c", "d")], "found string, truth string")
    assert tuple(evaluate.pairwise(alone).first()) == (None, None, None) and tuple(evaluate.bcubed(alone).first()) == (1, 1, 1)


def test_sweep_is_strict_and_first(spark):
    df = spark.createDataFrame([(0.5, 1), (0.7, 1), (0.2, 0), (None, 1)], "p double, y int")
    found = {r.threshold: r.f1 for r in evaluate.threshold_sweep(df, "p", "y", (0.1, 0.2, 0.3, 0.5)).collect()}
    assert found == pytest.approx({0.1: 0.8, 0.2: 1.0, 0.3: 1.0, 0.5: 2 / 3})
    assert evaluate.best_threshold(evaluate.threshold_sweep(df, "p", "y", (0.1, 0.2, 0.3, 0.5))).first().threshold == 0.2


def test_confusion_with_either_positive(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "p int, a int")
    assert evaluate.confusion(df, "p", "a").first().precision == 0.5
    assert evaluate.confusion(df, "p", "a", positive=0).first().precision == pytest.approx(2 / 3)


# Clusters


def naive_linkage(dist, cut):
    groups = [[i] for i in range(len(dist))]
    while len(groups) > 1:
        best = min(((max(dist[a][b] for a in g for b in h), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j))
        if best[0] > cut:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 8), st.integers(0, 10_000), st.floats(0.05, 0.95))
def test_complete_linkage_is_the_naive_one(n, seed, cut):
    rng = np.random.default_rng(seed)
    d = rng.random((n, n))
    d = np.triu(d, 1) + np.triu(d, 1).T
    merges, heights = cluster.complete_linkage(d)
    assert (np.diff(heights) >= -1e-12).all()
    label = cluster.cut_tree(n, merges, heights, cut)
    assert {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label)} == naive_linkage(d.tolist(), cut)


def test_clusters_of_blocks(spark):
    rows = [(1, 0, 2, 0, "K", 0.9), (2, 0, 1, 0, "K", 0.9), (1, 0, 3, 0, "K", 0.1), (2, 0, 3, 0, "K", 0.1), (7, 1, 8, 1, "L", 0.25), (9, 1, 7, 1, "L", None)]
    df = spark.createDataFrame(rows, "id1 long, d1 int, id2 long, d2 int, focus_name string, p double")
    found = {(r.focus_name, r.id): r.cluster for r in cluster.clusters(df).collect()}
    assert found == {("K", 1): 1, ("K", 2): 1, ("K", 3): 2, ("L", 7): 1, ("L", 8): 1}
    sweep = cluster.cut_sweep(df).toPandas()
    assert isinstance(sweep, pd.DataFrame) and sweep[sweep.cut == 0].groupby("focus_name").cluster.nunique().to_dict() == {"K": 3, "L": 2}


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 9), st.integers(0, 10_000), st.floats(0.05, 0.95))
def test_linkage_of_close_pairs_is_the_whole_one_below_the_cut(n, seed, cut):
    rng = np.random.default_rng(seed)
    d = np.round(rng.random((n, n)), 1)  # with ties
    d = np.triu(d, 1) + np.triu(d, 1).T
    close = [(i, j, d[i, j]) for i in range(n) for j in range(i + 1, n) if d[i, j] <= cut]
    whole, some = cluster.complete_linkage(d), cluster.linkage_of_pairs(n, close)
    assert cluster.cut_tree(n, *whole, cut).tolist() == cluster.cut_tree(n, *some, cut).tolist()


def test_empty_and_repeated_scores(spark):
    schema = "id1 long, d1 int, id2 long, d2 int, focus_name string, p double"
    empty = spark.createDataFrame([], schema)
    assert cluster.clusters(empty).count() == 0 and cluster.cut_sweep(empty).count() == 0
    rows = [(1, 0, 2, 0, "K", 0.9), (1, 0, 2, 0, "K", 0.9), (2, 0, 1, 0, "K", 0.1), (3, 0, 3, 1, None, 1.0), (4, 0, 5, 0, "K", 1.0)]
    mean = {(r.focus_name, r.id, r.d): r.cluster for r in cluster.clusters(spark.createDataFrame(rows, schema), 0.3).collect()}
    assert mean == {("K", 1, 0): 1, ("K", 2, 0): 2, ("K", 4, 0): 3, ("K", 5, 0): 3, (None, 3, 0): 1, (None, 3, 1): 1}
    one = cluster.clusters(spark.createDataFrame(rows, schema), 1.0).filter("focus_name = 'K'").collect()
    assert {r.cluster for r in one} == {1} and len(one) == 4


def test_best_cut_and_author_ids(spark):
    rows = [(1, 0, 2, 0, "K", 0.9), (3, 0, 4, 0, "K", 0.8), (1, 0, 3, 0, "K", 0.3), (1, 0, 4, 0, "K", 0.3), (2, 0, 3, 0, "K", 0.3), (2, 0, 4, 0, "K", 0.3)]
    df = spark.createDataFrame(rows, "id1 long, d1 int, id2 long, d2 int, focus_name string, p double")
    truth = spark.createDataFrame([(1, 0, "a"), (2, 0, "a"), (3, 0, "b"), (4, 0, "b"), (9, 9, "c")], "id long, d int, author_id string")
    scores = cluster.scores_of_cuts(cluster.cut_sweep(df), truth)
    by = {r.cut: (r.precision, r.recall, r.f1) for r in scores.collect()}
    assert by[0.0] == (None, 0.0, 0.0) and by[0.15][0] == 1 and by[0.15][1] == 0.5 and by[0.2] == (1, 1, 1) and by[0.75][0] == 1 / 3 and len(by) == 21
    assert cluster.best_cut(scores).first().cut == 0.2
    store = spark.createDataFrame([(40,), (7,)], "author_id long")
    ids = cluster.author_ids(cluster.clusters(df, 0.2), store).collect()
    assert {r.author_id for r in ids} == {41, 42} and len({r.author_id for r in ids if r.id in (1, 2)}) == 1 and len(ids) == 4


def test_class_distances_of_surnames(spark):
    s = spark.createDataFrame([(1, 0, "A"), (2, 0, "B"), (3, 0, "B"), (4, 0, "C"), (5, 0, None)], "id long, d int, last_name string")
    pairs = spark.createDataFrame([(1, 0, 2, 0), (1, 0, 3, 0), (2, 0, 4, 0), (1, 0, 5, 0)], "id1 long, d1 int, id2 long, d2 int")
    v = spark.createDataFrame([("A", 0, 1), ("B", 1, 1), ("B", 1, 0), (None, 1, 1)], "last_name string, x int, y int")
    assert [tuple(r) for r in distance.class_distances(pairs, s, v, ("x", "y")).collect()] == [("A", "B", 1 - 1 / 3)]


def test_split_by_block_of_many_keys(spark):
    keys = ["", "A", "AB", "ABC", "ABD", "B", "BA", "Z", "é"]
    rows = [(k,) for i, k in enumerate(keys) for _ in range(i + 1)]
    total, upto, expected = len(rows), 0, {}
    for i, k in enumerate(keys):
        upto += i + 1
        expected[k] = upto / total
    found = features.split_by_block(spark.createDataFrame(rows, "k string"), "k").collect()
    assert {r.k: r.cume for r in found} == pytest.approx(expected)
    assert {r.k: r.train for r in found} == {k: v < 0.7 for k, v in expected.items()}


# Stores and ingest


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "n", 0.0)], "k int, name string, v double")
    rows = spark.createDataFrame([(2, 20.0), (3, 30.0), (None, 9.0)], "k int, v double")
    once = store.upsert(target, rows, ("k",))
    assert sorted(map(repr, map(tuple, once.collect()))) == sorted(map(repr, [(1, "a", 1.0), (2, "b", 20.0), (3, None, 30.0), (None, "n", 0.0), (None, None, 9.0)]))
    known = rows.dropna()
    again = store.upsert(store.upsert(target, known, ("k",)), known, ("k",))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, store.upsert(target, known, ("k",)).collect()))


def test_upsert_takes_null_values(spark):
    target = spark.createDataFrame([(1, "a")], "k int, name string")
    assert store.upsert(target, spark.createDataFrame([(1, None)], "k int, name string"), ("k",)).first().name is None


def test_delete_ids_and_new_ids(spark):
    target = spark.createDataFrame([(1, 1), (2, 2), (None, 3)], "a int, b int")
    left = store.delete_in(target, spark.createDataFrame([(2,), (2,), (None,)], "k int"), {"a": "k"})
    assert sorted(r.b for r in left.collect()) == [1, 3]
    ids = store.with_new_ids(spark.range(50).toDF("x"), spark.createDataFrame([(7,)], "author_id long"), "author_id", ("x",))
    assert sorted(r.author_id for r in ids.collect()) == list(range(8, 58))
    first = store.with_new_ids(spark.range(3).toDF("x"), spark.createDataFrame([], "author_id long"), "author_id", ("x",))
    assert sorted(r.author_id for r in first.collect()) == [1, 2, 3]


def test_csv_keeps_blanks(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,d,first_name,fn_initial,mn_initial,last_name\n245,0,"J","J","","de Dinechin"\n')
    assert tuple(store.read_csv(spark, str(tmp_path / "s.csv")).first()) == (245, 0, "J", "J", "", "de Dinechin")


def test_distance_files_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, 2, "title", 0.5), (2, 1, "title", 0.5), (1, 3, "title", 1.0), (4, 5, "refs", 0.25)], "id1 long, id2 long, kind string, dist double")
    store.export_distances(d, str(tmp_path / "x"))
    read = store.import_distances(spark, str(tmp_path / "x"))
    assert sorted(map(tuple, read.collect())) == [(1, 2, "title", 0.5), (4, 5, "refs", 0.25)]
    into = spark.createDataFrame([(1, 2, "title", 0.9)], "id1 long, id2 long, kind string, dist double")
    assert store.import_distances(spark, str(tmp_path / "x"), into).count() == 2


def test_replace_reads_and_writes_one_path(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    store.replace(spark.read.parquet(path).filter("id > 2"), path)
    assert spark.read.parquet(path).count() == 2


def test_tables_are_created_filled_and_emptied(spark, tmp_path):
    root = str(tmp_path / "db")
    kinds = {"distances": "id1 int, id2 int, dist double, focus_name string", "lda_topic": schema.SCHEMAS["lda_topic"]}
    store.create(spark, root, kinds, {"distances": ("focus_name",)})
    read = lambda name: spark.read.schema(kinds[name]).parquet(f"{root}/{name}")
    assert read("distances").count() == read("lda_topic").count() == 0
    rows = spark.createDataFrame([(1, 2, 0.5, "A"), (1, 3, 0.25, "B/C"), (4, 5, 0.1, None)], "id2 long, id1 long, dist double, focus_name string")
    store.append(rows, f"{root}/distances", kinds["distances"], ("focus_name",))
    store.append(rows.select("id1", "id2").limit(1), f"{root}/distances", kinds["distances"], ("focus_name",))
    assert sorted(map(repr, map(tuple, read("distances").collect()))) == sorted(map(repr, [(2, 1, 0.5, "A"), (3, 1, 0.25, "B/C"), (5, 4, 0.1, None), (2, 1, None, None)]))
    with pytest.raises(ValueError, match="nosuch"):
        store.append(rows.withColumn("nosuch", F.lit(1)), f"{root}/distances", kinds["distances"], ("focus_name",))
    store.delete_partitions(spark, f"{root}/distances", "focus_name", spark.createDataFrame([("B/C",), ("none such",)], "v string"))
    assert sorted(r.dist for r in read("distances").dropna().collect()) == [0.5]
    store.delete_partitions(spark, f"{root}/distances", "focus_name", spark.createDataFrame([(None,)], "v string"))
    assert read("distances").count() == 1
    store.truncate(spark, f"{root}/distances", kinds["distances"])
    assert read("distances").count() == 0


def test_models_are_saved_and_loaded(spark, tmp_path):
    from namesake.plans import classify

    rng = np.random.default_rng(1)
    values = rng.random((200, len(features.FEATURES)))
    rows = [(i, 0, i + 1, 0, "k", *map(float, v), int(v[0] > 0.5)) for i, v in enumerate(values)]
    names = ["id1", "d1", "id2", "d2", "focus_name", *features.FEATURES, "same_author"]
    df = spark.createDataFrame(rows, names)
    for method, options in (("svm", {}), ("forest", {"trees": 5})):
        model = classify.fit(df, method, **options)
        classify.save(model, str(tmp_path / "m"))
        again = classify.load(str(tmp_path / "m"))
        assert sorted(map(tuple, classify.predict(again, df).collect())) == sorted(map(tuple, classify.predict(model, df).collect()))


def test_key_check(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (None, 0)], "id int, d int")
    with pytest.raises(ValueError, match="repeats"):
        schema.require_key(df, ("id", "d"))
    assert schema.require_key(df.limit(1), ("id", "d")).count() == 1


ARTICLE = {
    "title": "T", "journal": "J", "year": 2016, "doi": "10.1", "authors": [{"last_name": "Walker", "first_name": "John", "middle_name": "Q"}],
    "keywords": ["k1", "k2"], "subjects": ["s"], "references": [{"title": "r", "journal": "rj"}],
}


def test_ingest(spark):
    t = ingest.article_tables(spark, ARTICLE, 5, 9)
    assert tuple(t["articles"].first()) == (9, 5, "T", "J", None, "10.1", 2016)
    assert tuple(t["signatures"].first()) == (5, 0, "John", "J", "Q", "Walker", "Q")
    assert t["keywords"].count() == 2
    for key, name in ingest.REQUIRED:
        with pytest.raises(ValueError, match=f"{name} missing"):
            ingest.validate({k: v for k, v in ARTICLE.items() if k != key})
    entry = ingest.catalogue_entry({"title": "T", "source": "S", "identifiers": {"doi": "d"}, "authors": [{"first_name": "J. R.", "last_name": "T"}]})
    assert entry["journal"] == "S" and entry["doi"] == "d" and entry["authors"] == [{"last_name": "T", "first_name": "J", "middle_name": "R"}]
