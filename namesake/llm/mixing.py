"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import discard, written

#: Targets are observed token shares to this power, so small sources, languages and topics gain and large ones lose.
FLATTEN = 0.7
#: Share of all tokens that the sample holds in expectation.
KEEP = 0.8
#: Raking ends when no margin is off by more than this share of its target, or, with a warning, after so many rounds.
TOLERANCE, ROUNDS, ROUNDS_A_JOB = 1e-9, 500, 4
#: Cells, of some 100 bytes, up to which one task rakes them without a shuffle; more are shuffled by margin.
ONE_TASK = 1_000_000
SEED = 17
MARGINS = ("source", "lang", "topic")
#: Topics by the first pattern that the text holds, in order.
TOPICS = (("legal", r"(?i)licen[sc]e|copyright|all rights reserved"), ("contact", r"[A-Za-z0-9._]+@[A-Za-z0-9]|\+[0-9]+ \([0-9]"), ("table", r" \| [^|]* \| "), ("web", r"https?://|www\."))
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
_NONE = "\0"


def topic_of(text: Column) -> Column:
    """A coarse topic: the first of ``TOPICS``, else brief (under 100 tokens' worth of characters) or prose."""
    found = F.lit(None)
    for name, pattern in reversed(TOPICS):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return F.coalesce(found, F.when(F.char_length(text) < 500, "brief").otherwise("prose"))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text, source, lang, topic, n_tokens and draw of every row; a missing category is a category of its own."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.coalesce(F.col("source").cast("string"), F.lit(_NONE)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(_NONE)).alias("lang"),
        topic_of(text).alias("topic"),
        F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("n_tokens"),
        uniform(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.md5(text.cast("binary")))).alias("draw"),
    )


def uniform(name: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) for each name, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{seed}")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, *, flatten: float = FLATTEN, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """``source, lang, topic, tokens, weight``: weights of the cells with the targets as their margins.

    ``targets`` maps a margin to a table (its name, share), shares being scaled to those names that there are; a margin without one gets the
    observed shares to the power of ``flatten``. A round scales the weights to each margin's targets in turn. Up to ``ONE_TASK`` cells are
    raked by one task, sums by margin being windows there. More are shuffled: sums are taken before the shuffle and joined back,
    in tables, so that adaptive execution can split the cells of a common name. Cells without tokens stay 0. Targets that
    no weights meet (a source without share that alone has a language, say) end the rounds with a warning that says how far off they are.
    """
    few = cells.count() <= ONE_TASK
    fitted = cells.select(*MARGINS, "tokens", F.col("tokens").cast("double").alias("weight"), F.lit(0.0).alias("off"))
    for m in MARGINS:
        goal = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("have"))
        if targets and m in targets:
            goal = goal.join(targets[m].select(m, F.col("share").cast("double").alias("share")), m, "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        else:
            goal = goal.withColumn("share", F.pow("have", F.lit(flatten)))
        goal = goal.select(m, F.when(F.col("have") > 0, F.col("share")).otherwise(0.0).alias("share"))
        whole = goal.agg(F.sum("share")).first()[0] or 1.0
        fitted = fitted.join(goal.select(m, (F.col("share") / whole).alias(f"g_{m}")), m)
    fitted = written(fitted.coalesce(1) if few else fitted, "raking")

    def scaled(fitted: DataFrame, m: str) -> DataFrame:
        if few:
            summed = fitted.withColumn("have", F.sum("weight").over(Window.partitionBy(m)))
        else:
            summed = fitted.join(written(fitted.groupBy(m).agg(F.sum("weight").alias("have")), "sums"), m)
        some = (F.col("have") > 0) & (F.col(f"g_{m}") > 0)
        off = F.greatest("off", F.when(some, F.abs(F.col("have") / F.col(f"g_{m}") - 1)).otherwise(0.0))
        summed = summed.withColumns({"weight": F.when(some, F.col("weight") * F.col(f"g_{m}") / F.col("have")).otherwise(0.0), "off": off}).drop("have")
        return summed if few else written(summed, "raking")

    off, done = 0.0, 0
    while done < rounds:
        old, fitted = fitted, fitted.coalesce(1) if few else fitted
        for _ in range(ROUNDS_A_JOB if few else 1):
            fitted = fitted.withColumn("off", F.lit(0.0))
            for m in MARGINS:
                fitted = scaled(fitted, m)
            done += 1
        fitted = written(fitted, "raking") if few else fitted
        discard(old)
        off = fitted.agg(F.max("off")).first()[0] or 0.0
        if off <= tolerance:
            break
    else:
        warnings.warn(f"after {done} rounds a margin is off by {off:.3g} of its target", stacklevel=2)
    return fitted.select(*MARGINS, "tokens", "weight")


def calibrated(fitted: DataFrame, keep: float) -> DataFrame:
    """``fitted`` with ``probability``: min(1, c * weight / tokens), c such that the sample's expected tokens are ``keep``
    of all. Found by fixing what is above 1 and sharing the rest anew, until no more cells are fixed; each step brings four sums to the driver."""
    fitted = fitted.withColumn("factor", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    scale, before = 0.0, -1
    while True:
        sure = F.col("factor") * scale >= 1 if scale else F.lit(False)
        sums = fitted.agg(F.sum("tokens"), F.sum(F.when(sure, F.col("tokens")).otherwise(0)), F.sum(F.when(sure, 0.0).otherwise(F.col("tokens") * F.col("factor"))), F.sum(sure.cast("long")))
        total, fixed, rest, cells = sums.first()
        if not total or not rest or cells == before:
            break
        scale, before = (keep * total - fixed) / rest, cells
    sampled = F.least(F.lit(1.0), F.col("factor") * scale)
    return fitted.select(*MARGINS, "weight", F.when(F.col("tokens") > 0, sampled).otherwise(1.0).alias("probability"))


def mixed(docs: DataFrame, *, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, with_text: bool = False) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, probability, sampled`` (and ``text``) for every row of ``docs(doc_id, text, source, lang)``.

    Token weights of the cells source x language x topic are raked to the margins, and a row is sampled if a fixed random
    number of its doc_id (of its text, without one) is below its cell's probability. Null sources and languages are categories of their
    own, null again in the result; null and empty texts have no tokens, and cells without tokens are kept whole, as they weigh nothing.
    Long texts count whole. Repeated rows share their fate. An empty table gives an empty result. Other columns are not read.
    """
    rows = described(docs)
    rows = written(rows if with_text else rows.drop("text"), "described")  # texts are read and matched once
    cells = written(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    table = written(calibrated(rake(cells, targets), keep), "probabilities")
    return rows.join(table, list(MARGINS)).select(
        "doc_id", *["text"] * with_text, F.nullif("source", F.lit(_NONE)).alias("source"), F.nullif("lang", F.lit(_NONE)).alias("lang"), "topic", "n_tokens", "probability",
        (F.col("draw") < F.col("probability")).alias("sampled"),
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("probability", F.round("probability", 6))


def _oracle() -> str:
    topic = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for n, p in TOPICS) + " WHEN length(x) < 500 THEN 'brief' ELSE 'prose' END"
    keys = ", ".join(MARGINS)
    parts = [
        f"rows_ AS MATERIALIZED (SELECT doc_id, coalesce(doc_id::VARCHAR, md5(x)) AS name, coalesce(source, chr(1)) AS source, coalesce(lang, chr(1)) AS lang, {topic} AS topic, len(regexp_extract_all(x, '{TOKEN}')) AS n_tokens FROM (SELECT *, coalesce(text, '') AS x FROM documents))",
        f"cells AS MATERIALIZED (SELECT {keys}, sum(n_tokens)::DOUBLE AS tokens FROM rows_ GROUP BY ALL)",
    ]
    for m in MARGINS:
        parts.append(f"s_{m} AS (SELECT {m}, pow(sum(tokens), {FLATTEN}) AS share FROM cells GROUP BY 1), t_{m} AS MATERIALIZED (SELECT {m}, share / sum(share) OVER () AS t_{m} FROM s_{m})")
    parts.append("w0 AS MATERIALIZED (SELECT *, tokens AS weight FROM cells " + " ".join(f"JOIN t_{m} USING ({m})" for m in MARGINS) + ")")
    n = 0
    for _ in range(40):  # enough to be as near on these tables
        for m in MARGINS:
            n += 1
            parts.append(f"w{n} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {m}) > 0 THEN weight * t_{m} / sum(weight) OVER (PARTITION BY {m}) ELSE 0 END AS weight) FROM w{n - 1})")
    parts.append(f"f AS MATERIALIZED (SELECT {keys}, tokens, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS factor FROM w{n})")
    # With the cells of highest factor sure, the rest share what is left; the first such scale that leaves the next below 1.
    parts.append(f"o AS (SELECT factor, {KEEP} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY factor DESC, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_, sum(tokens * factor) OVER (ORDER BY factor DESC, {keys} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER (ORDER BY factor DESC, {keys}) AS k FROM f)")
    parts.append("c AS (SELECT left_ / rest AS scale FROM o WHERE rest > 0 AND left_ / rest * factor < 1 ORDER BY k LIMIT 1)")
    p = "CASE WHEN tokens > 0 THEN least(1.0, factor * coalesce((SELECT scale FROM c), 0)) ELSE 1.0 END"
    u = f"('0x' || substr(md5(name || ':{SEED}'), 1, 12))::BIGINT::DOUBLE / {float(1 << 48)!r}"
    return f"WITH {', '.join(parts)} SELECT doc_id, nullif(source, chr(1)) AS source, nullif(lang, chr(1)) AS lang, topic, n_tokens, round({p}, 6) AS probability, {u} < {p} AS sampled FROM rows_ JOIN f USING ({keys})"


ORACLE = _oracle()
