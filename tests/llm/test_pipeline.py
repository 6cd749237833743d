import re

import corpus_pipeline
from corpus_pipeline import COLUMNS, STAGES
from pyspark.sql import functions as F

from namesake.llm import mixing

from .conftest import SCHEMA, odd_rows, words
from .test_near_dedup import brute as near_brute
from .test_suffix_dedup import brute as suffix_brute
from .test_tokens import PATH

TINY = "/root/testdata/sf0.001"


def test_stages_are_the_five_in_order():
    assert [n for n, _ in STAGES] == ["language_id", "near_dedup", "suffix_dedup", "mixing", "bpe"]


def test_each_stage_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    stage = dict(STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    first = stage["language_id"](spark, docs, TINY)
    assert tuple(first.columns) == COLUMNS
    kept = {r.doc_id: r.text for r in first.collect()}
    assert kept == {i: r.text for i, r in rows.items() if re.search(r"[^\W\d_]", r.text or "")}

    second = stage["near_dedup"](spark, first, TINY)
    assert tuple(second.columns) == COLUMNS
    one = {i for i, (_, _, k) in near_brute(list(kept.items())).items() if k}
    assert sorted(r.doc_id for r in second.collect()) == sorted(one)

    third = stage["suffix_dedup"](spark, second, TINY)
    assert tuple(third.columns) == COLUMNS
    left = {r.doc_id: r for r in third.collect()}
    before = {i: kept[i] for i in sorted(one)}
    for (i, text), (n, gone, _, _) in zip(before.items(), suffix_brute(list(before.values())), strict=True):
        assert left[i].n_chars == len(left[i].text) and (gone > 0 or left[i].text == text) and n - gone >= len(left[i].text.encode()) >= n - gone - 6

    fourth = stage["mixing"](spark, third, TINY)
    assert tuple(fourth.columns) == COLUMNS
    sampled = {r.doc_id for r in mixing.mixed(third).filter("sampled").collect()}
    assert {r.doc_id for r in fourth.collect()} == sampled and 0 < len(sampled) < len(left)

    last = stage["bpe"](spark, fourth, TINY).collect()
    library = Tokenizer.from_file(PATH)
    assert {r.doc_id: list(r.ids) for r in last} == {i: library.encode(left[i].text, add_special_tokens=False).ids for i in sampled}


def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    for _, f in STAGES:
        docs = f(spark, docs, TINY)
    assert sorted(map(tuple, docs.select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, TINY).select("doc_id", "ids_sha256").collect()))


def test_odd_and_empty_tables(spark, odd, empty):
    for table, n in ((odd, 10), (empty, 0)):
        docs = table
        for _, f in STAGES:
            docs = f(spark, docs, TINY)
        assert docs.count() >= n
    assert odd.select(F.col("doc_id")).count() > 10


def least_of_each_class(rows):
    """The texts of the first row of each class, rows in order of doc_id, null last; wordless ones all."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    return sorted((r[1] or "" for (r, (_, _, kept)) in zip(rows, near_brute([(k, r[1]) for k, r in enumerate(rows)]).values(), strict=True) if kept))


def test_one_row_of_each_class_keeps_its_text(spark, odd):
    stage = dict(STAGES)
    texts = [words(120, k) for k in range(6)]
    edited = [t.replace(t.split()[60], "changed", 1) for t in texts]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[0]), (2, edited[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (None, edited[2]), (4, texts[3]), (None, edited[3]), (5, texts[4]), (5, texts[4].upper()), (None, texts[5])]
    docs = spark.createDataFrame([(*r, "en", "a", k) for k, r in enumerate(rows)], SCHEMA)
    second = stage["near_dedup"](spark, docs, TINY)
    left = sorted((r.doc_id or 0, r.text) for r in second.collect())
    assert [(i, t) for i, t in left if i] == [(1, texts[0]), (4, texts[3]), (5, next(t for i, t in left if i == 5))]
    assert [t for i, t in left if not i] == sorted(t for t in (texts[1], next(t for _, t in left if t in (texts[2], edited[2])), texts[5]))
    third = stage["suffix_dedup"](spark, second, TINY)
    assert sorted((r.doc_id or 0, r.text) for r in third.collect()) == left

    after = stage["near_dedup"](spark, odd, TINY).collect()
    assert sorted(r.text or "" for r in after) == least_of_each_class(odd_rows())


def test_texts_of_no_learned_language_go(spark):
    known = [(k, words(60, k), "en" if k % 2 else "fr", "a", 1) for k in range(40)]
    unknown = [(100, "никто не знает этого языка здесь", None, "a", 1), (101, "QXZ " * 20, None, "a", 1)]
    docs = spark.createDataFrame(known + unknown, SCHEMA)
    assert sorted(r.doc_id for r in dict(STAGES)["language_id"](spark, docs, TINY).collect()) == [r[0] for r in known]
