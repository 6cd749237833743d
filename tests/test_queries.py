"""Registered queries against DuckDB, models on planted data, the stream of batches."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from namesake.plans import classify, queries, surname, testdata, topics, workflow
from namesake.streaming.batches import article_stream, resolve_stream

TINY = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return c


def shaped(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return list(frame.columns), sorted(repr([clean(v) for v in row]) for row in frame.astype(object).to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert shaped(queries.QUERIES[name](spark, TINY).toPandas()) == shaped(duck.sql(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"classified_pairs", "name_classes", "article_topics"}))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, TINY).count() > 0


def test_clusters_of_a_table_are_the_naive_ones(spark):
    scored = workflow.run_batch(testdata.corpus(spark, TINY)).toPandas()
    near, items = {}, {}
    for r in scored.itertuples():
        a, b = (r.id1, r.d1), (r.id2, r.d2)
        items.setdefault(r.focus_name, set()).update((a, b))
        near.setdefault(frozenset((a, b)), []).append(1 - r.p)
    expected = set()
    for block in items.values():
        groups = [[x] for x in sorted(block, key=lambda x: f"{x[0]}-{x[1]}")]
        while len(groups) > 1:
            height = lambda g, h: max(sum(v) / len(v) for a in g for b in h for v in [near.get(frozenset((a, b)), [1.0])])
            x, i, j = min((height(g, h), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
            if x > 0.8:
                break
            groups[i] += groups.pop(j)
        expected |= {frozenset(g) for g in groups}
    found = queries.QUERIES["author_clusters"](spark, TINY).toPandas()
    assert {frozenset(zip(g.id, g.d, strict=True)) for _, g in found.groupby(["focus_name", "cluster"])} == expected


def test_a_trained_model_scores_a_run(spark, tmp_path):
    c = testdata.corpus(spark, TINY)
    rows = workflow.batch_features(c).withColumn("same_author", (F.col("eq_fn_initial") == 1).cast("int"))
    classify.save(classify.fit(rows, "forest", trees=5), str(tmp_path / "m"))
    model = classify.load(str(tmp_path / "m"))
    corpus = queries.features.topic_corpus(c.articles, c.keywords)
    topic_model = topics.fit(corpus, iterations=1)
    some = testdata.topics(spark, TINY).filter("id % 2 = 0")
    c.topics = some
    known = workflow.run_trained(c, model).count()
    whole = workflow.run_trained(c, model, topic_model=topic_model).toPandas()
    assert known < len(whole) == workflow.batch_features(testdata.corpus(spark, TINY)).count()
    assert whole.p.between(0, 1).all() and list(whole.columns) == ["id1", "d1", "id2", "d2", "focus_name", "p", "same"]


def test_process_ids_are_numbers():
    assert workflow.valid_process_id("12") == 12
    for bad in ("1; drop", "", "-1", "x"):
        with pytest.raises(ValueError, match="not a number"):
            workflow.valid_process_id(bad)


def planted(spark, n=600):
    from namesake.operators.features import FEATURES

    base = spark.range(n).withColumn("same_author", (F.rand(1) < 0.4).cast("int"))
    made = base.select("id", "same_author", *(((1 - F.col("same_author")) * 0.6 + F.rand(i + 5) * 0.5).alias(f) if f.startswith("dist") else F.col("same_author").cast("double").alias(f) if f == "eq_fn_initial" else F.rand(i + 50).alias(f) for i, f in enumerate(FEATURES)))
    return made.cache()


@pytest.mark.parametrize("method", classify.METHODS)
def test_classifiers_recover_planted_labels(spark, method):
    rows = planted(spark)
    options = {"forest": {"trees": 20}, "boosting": {"rounds": 10}}.get(method, {})
    scored = classify.score(classify.fit(rows, method, **options), rows)
    right = scored.select(F.avg(((F.col("p") >= 0.5) == (F.col("same_author") == 1)).cast("int"))).first()[0]
    assert right > 0.95


def test_missing_features_have_no_score(spark):
    rows = planted(spark)
    model = classify.fit(rows, "boosting", rounds=3)
    blank = rows.limit(5).withColumn("diff_year", F.lit(None).cast("double"))
    assert {r.p for r in classify.score(model, blank).collect()} == {None}


def test_elimination_keeps_the_telling_feature(spark):
    found = classify.eliminate(planted(spark), sizes=(2, 5), trees=10)
    assert [len(f) for f, _ in found] == [5, 2] and "eq_fn_initial" in found[-1][0] and found[-1][1] > 0.9


def test_topics_split_planted_subjects(spark):
    rows = [(i, ("gravity orbit planets stars galaxies telescope " if i % 2 else "enzyme protein membrane cells receptor genome ") * 4) for i in range(40)]
    corpus = spark.createDataFrame(rows, "id long, text string")
    model = topics.fit(corpus, k=2, iterations=30)
    found = {r.id: r.topic for r in topics.infer(corpus, model).collect()}
    assert len({found[i] for i in range(0, 40, 2)}) == 1 and len({found[i] for i in range(1, 40, 2)}) == 1 and found[0] != found[1]
    known = spark.createDataFrame([(i, 1) for i in range(38)], "id long, topic int")
    assert {r.id for r in topics.infer(corpus, model, known).collect()} == {38, 39} and topics.infer(corpus, model, limit=3).count() == 3


def test_surname_classes(spark):
    shares = spark.createDataFrame([("A", "75.1", "(S)"), ("B", "60", "31"), ("C", None, "2")], "name string, x string, y string")
    assert {tuple(r) for r in surname.labels_from_shares(shares, {"x": 60.0, "y": 30.0}).collect()} == {("A", 1, 0), ("B", 0, 1), ("C", 0, 0)}
    rows = [(("XO" if i % 2 else "LE") + chr(65 + i % 26) + chr(65 + i // 26) + ("OX" if i % 2 else "EL"), i % 2) for i in range(200)]
    model, held = surname.fit(spark, spark.createDataFrame(rows, "name string, c int"), "c")
    assert held.select(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] > 0.95
    names = spark.createDataFrame([("Xoabox",), ("Leabel",), ("Leabel",), (None,)], "last_name string")
    assert {tuple(r) for r in surname.infer(names, {"c": model}).collect()} == {("Xoabox", 1), ("Leabel", 0)}


def test_stream_resolves_each_batch_once(spark, tmp_path):
    folder, sink = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.json").write_text(json.dumps({"processid": k, "id": k, "title": f"t{k}"}) + "\n")
        stream = resolve_stream(article_stream(spark, str(folder)), lambda batch: batch.select("id", "title"), sink, str(tmp_path / "cp"))
        stream.awaitTermination(120)
    assert sorted((r.id, r.title) for r in spark.read.parquet(sink).collect()) == [(0, "t0"), (1, "t1")]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id1", "d1", "id2", "d2", "focus_name", "p", "same"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
