"""Aggregated signature information, pair features and the split by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distance import KINDS

FEATURES = ("eq_fn_initial", "eq_mn_initial", "eq_lda_topic", "diff_year", "dist_keywords", "dist_refs", "dist_subject", "dist_title", "dist_coauthor", "dist_ethnicity")


def listed(child: DataFrame, value: str, out: str) -> DataFrame:
    """``id, out``: the values of each article, sorted, nulls left out."""
    return child.groupBy("id").agg(F.array_sort(F.collect_list(value)).alias(out))


def signature_info(signatures: DataFrame, articles: DataFrame, keywords: DataFrame, references: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row for each signature with its article's title and lists; children are aggregated before they are joined."""
    base = signatures.join(articles.select("id", "title", "year"), "id")
    for child, value, out in ((keywords, "keyword", "keywords"), (references, "journal", "references"), (subjects, "subject", "subjects"), (signatures, "focus_name", "coauthors")):
        base = base.join(listed(child, value, out), "id", "left")
    return base


def topic_corpus(articles: DataFrame, keywords: DataFrame) -> DataFrame:
    """``id, text``: keywords, then title, lower case; what is null is left out."""
    joined = keywords.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("keyword")), ", ").alias("keywords"))
    return articles.join(joined, "id", "left").select("id", F.concat_ws(", ", F.lower("keywords"), F.lower("title")).alias("text"))


def first_per_group(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The ``n`` first rows of each group by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_n") <= n).drop("_n")


def _equal(a: Column, b: Column) -> Column:
    return F.when(a == b, 1).otherwise(0)


def pair_features(pairs: DataFrame, signatures: DataFrame, articles: DataFrame, topics: DataFrame, distances: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``id1, d1, id2, d2, focus_name`` and ``FEATURES`` of each candidate pair whose articles both have a topic.

    ``distances`` is wide and unordered (id1 < id2), ``classes`` holds last_name_1, last_name_2, dist. A missing distance is 1, an equality
    with a null side 0, a difference of years with one null; two signatures of one article are at distance 0.
    """
    s = signatures.select("id", "d", "last_name", "fn_initial", "mn_initial").join(articles.select("id", "year"), "id").join(topics.select("id", "topic"), "id")
    side = lambda k: s.select(*(F.col(c).alias(f"{c}{k}") for c in s.columns))
    rows = pairs.join(side(1), ["id1", "d1"]).join(side(2), ["id2", "d2"])
    rows = rows.withColumns({"a": F.least("id1", "id2"), "b": F.greatest("id1", "id2")})
    rows = rows.join(distances.withColumnsRenamed({"id1": "a", "id2": "b"}), ["a", "b"], "left")
    if classes is not None:
        kept = classes.groupBy("last_name_1", "last_name_2").agg(F.min("dist").alias("dist_ethnicity"))
        rows = rows.join(kept.withColumnsRenamed({"last_name_1": "last_name1", "last_name_2": "last_name2"}), ["last_name1", "last_name2"], "left")
    else:
        rows = rows.withColumn("dist_ethnicity", F.lit(None).cast("double"))
    dist = lambda k: F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.coalesce(f"dist_{k}", F.lit(1.0))).alias(f"dist_{k}")
    made = {
        "eq_fn_initial": _equal(F.col("fn_initial1"), F.col("fn_initial2")).alias("eq_fn_initial"),
        "eq_mn_initial": _equal(F.col("mn_initial1"), F.col("mn_initial2")).alias("eq_mn_initial"),
        "eq_lda_topic": _equal(F.col("topic1"), F.col("topic2")).alias("eq_lda_topic"),
        "diff_year": F.abs(F.col("year1") - F.col("year2")).alias("diff_year"),
        "dist_ethnicity": F.coalesce("dist_ethnicity", F.lit(1.0)).alias("dist_ethnicity"),
    } | {f"dist_{k}": dist(k) for k in KINDS}
    return rows.select("id1", "d1", "id2", "d2", "focus_name", *(made[f] for f in FEATURES))


def split_by_block(rows: DataFrame, key: str, share: float = 0.7) -> DataFrame:
    """``key, cume, train``: the cumulative share of rows up to each (text) key in order of keys; those below ``share`` train.

    Rows are counted by key before the running sum. Keys are then summed within their first two characters, and only the totals of
    these, whose number does not grow with the rows, pass through one ordered window. A null key is the first.
    """
    counted = rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("_head", F.substring(key, 1, 2))
    heads = counted.groupBy("_head").agg(F.sum("n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select(F.col("_head").alias("_of"), before.alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    upto = F.sum("n").over(Window.partitionBy("_head").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    within = counted.select(key, "_head", upto.alias("_upto")).join(heads, F.col("_head").eqNullSafe(F.col("_of")))
    cume = within.select(key, ((F.col("_before") + F.col("_upto")) / F.col("_all")).alias("cume"))
    return cume.withColumn("train", F.col("cume") < share)
