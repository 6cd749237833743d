"""Quality rules with adaptive thresholds from mergeable quantile sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._store import written

#: Base rules: fewest words, and most repeated words in a hundred.
MIN_WORDS, MAX_REPEAT = 50, 50
#: A sketch bucket spans this ratio, so a quantile is off by at most half of it.
GAMMA = 1.005
#: Spreads of the group between its middle and a threshold.
FENCE = 16
#: Features in thousandths of their base; where a low value is as odd as a high one, the group sets a lower threshold too.
BOTH_SIDES = ("word_length",)
#: Fewest texts for a sketch of a language and source to stand alone; smaller groups use the language's, then the corpus's.
MIN_GROUP = 50

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LEAD = ~B.SPACE & ((np.arange(256) & 0xC0) != 0x80)


def _per_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[starts[1:]] - total[starts[:-1]]


def text_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of ``_COUNTS`` for each text."""
    buf, starts = B.joined(texts)
    out = {"word_chars": _per_text(_LEAD[buf], starts), "n_symbols": _per_text(_SYMBOL[buf], starts), "n_upper": _per_text(_UPPER[buf], starts)}

    ws, we = B.word_spans(buf)
    word, bounds = B.classes(buf, ws, we), np.searchsorted(ws, starts)
    out["n_words"] = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), out["n_words"])
    n = max(0, len(word) - 2)
    inside = np.flatnonzero(owner[:n] == owner[2:]) if n else np.zeros(0, np.int64)
    # Windows by exact numbers: of the first two words, of those and the third, of those and the text.
    run = word[inside]
    for part in (word[inside + 1], word[inside + 2], owner[inside]):
        run = np.unique(run * (int(part.max(initial=0)) + 1) + part, return_inverse=True)[1]
    twice = inside[np.bincount(run, minlength=1)[run] > 1]
    covered = np.zeros(len(word) + 1, bool)
    for j in range(3):
        covered[twice + j] = True
    out["n_repeat_words"] = _per_text(covered[:-1], bounds)

    breaks = np.flatnonzero(buf == 10)
    ls = np.concatenate(([0], breaks[:-1] + 1))
    worded = np.searchsorted(ws, breaks) > np.searchsorted(ws, ls)
    ls, le = ls[worded], breaks[worded]
    text = np.searchsorted(starts, ls, side="right") - 1
    _, first = np.unique(B.classes(buf, ls, le) * len(texts) + text, return_index=True)
    again = np.ones(len(ls), np.int64)
    again[first] = 0
    out["n_lines"] = np.bincount(text, minlength=len(texts))
    out["n_dup_lines"] = np.bincount(text, weights=again, minlength=len(texts)).astype(np.int64)
    return out


def _measure(carry: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = B.Texts(batch.column("text"))
            for i, j in B.chunks(texts):
                counts = text_counts(texts[i:j])
                own = [batch.column(k).slice(i, j - i) for k in range(carry)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(counts[c].astype(np.int64)) for c in _COUNTS)], [*batch.schema.names[:carry], *_COUNTS])

    return run


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row of ``docs``."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return chosen.mapInArrow(B.lean(_measure(3)), "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


_FEATURES = {
    "symbols": "n_symbols * 1000 div greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines * 1000 div greatest(n_lines, 1)",
    "repeats": "n_repeat_words * 1000 div greatest(n_words, 1)",
    "upper": "n_upper * 1000 div greatest(word_chars, 1)",
    "word_length": "word_chars * 1000 div greatest(n_words, 1)",
}


def sketches(features: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by, feature, bucket, n``: a quantile sketch for each group, texts counted in buckets of equal ratio.

    Sketches merge by adding the counts of equal buckets, so partial ones are summed before the shuffle.
    """
    stacked = features.select(*by, F.expr("stack({}, {}) as (feature, value)".format(len(_FEATURES), ", ".join(f"'{k}', {k}" for k in _FEATURES))))
    bucket = F.when(F.col("value") <= 0, -1).otherwise(F.ceil(F.log(F.greatest(F.col("value"), F.lit(1)).cast("double")) / math.log(GAMMA))).cast("int")
    return stacked.groupBy(*by, "feature", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return sketch.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))


#: Quantiles, in hundredths, that a sketch is asked for.
_QUANTILES = (25, 50, 90, 99)
#: A threshold from quantiles: so many spreads above the median, the spread being that from the lower quartile to the median,
#: or, where that is nothing, above the quantile that is first beyond the median, the spread being its distance.
_HIGH = f"case when q50 > q25 then q50 + {FENCE} * (q50 - q25) when q90 > q50 then q90 + {FENCE} * (q90 - q50) else q99 + {FENCE} * (q99 - q50) end"
_LOW = f"case when q50 > q25 then q50 - {FENCE} * (q50 - q25) end"


def thresholds(sketch: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by, texts``, a column t_<feature> for each feature and b_<feature> for those of ``BOTH_SIDES``, from the group's sketch."""
    group = Window.partitionBy(*by, "feature")
    running = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    placed = sketch.select(*by, "feature", "bucket", running.alias("upto"), F.sum("n").over(group).alias("texts"))
    value = F.when(F.col("bucket") < 0, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") - 0.5))
    at = (F.min(F.when(F.col("upto") * 100 >= F.col("texts") * q, value)).alias(f"q{q}") for q in _QUANTILES)
    fences = placed.groupBy(*by, "feature").agg(F.first("texts").alias("texts"), *at).select(*by, "feature", "texts", F.expr(_HIGH).alias("high"), F.expr(_LOW).alias("low"))
    pick = lambda side, k: F.max(F.when(F.col("feature") == k, F.col(side)))
    return fences.groupBy(*by).agg(F.first("texts").alias("texts"), *(pick("high", k).alias(f"t_{k}") for k in _FEATURES), *(pick("low", k).alias(f"b_{k}") for k in BOTH_SIDES))


def judge(docs: DataFrame, *, min_group: int = MIN_GROUP) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` for every row of
    ``docs(doc_id, text, lang, source)``.

    A text that passes the base rules fails where a feature is beyond a threshold of its language and source, which are taken from the
    quantiles of that group's texts that pass them. A group of fewer than ``min_group`` such texts takes the thresholds of its
    language, or, if those are as few, of the corpus; null lang and null source are groups like others. A null or empty
    text has no words and fails the base rules; a long text is counted whole. Repeated rows count each time; an empty table gives an empty
    result; other columns are not read.
    """
    counted = written(measure(docs), "counts")
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words")
    features = counted.select("doc_id", F.coalesce("lang", F.lit("\0")).alias("g_lang"), F.coalesce("source", F.lit("\0")).alias("g_source"), *_COUNTS, failed.alias("base_failed"), *(F.expr(e).alias(k) for k, e in _FEATURES.items()))
    fine = written(sketches(features.filter("not base_failed"), ("g_lang", "g_source")), "sketches")
    names = [*(f"t_{k}" for k in _FEATURES), *(f"b_{k}" for k in BOTH_SIDES)]
    own = thresholds(fine, ("g_lang", "g_source"))
    lang = thresholds(merged(fine, ("g_lang",)), ("g_lang",)).toDF("g_lang", "lang_texts", *(f"lang_{n}" for n in names))
    every = thresholds(merged(fine.withColumn("all", F.lit(0)), ("all",)), ("all",)).drop("texts").toDF("all", *(f"all_{n}" for n in names))
    group = own.join(lang, "g_lang").withColumn("all", F.lit(0)).join(every, "all")
    use = lambda n: F.when(F.col("texts") >= min_group, F.col(n)).when(F.col("lang_texts") >= min_group, F.col(f"lang_{n}")).otherwise(F.col(f"all_{n}"))
    # Written, the table has a known size: small it is broadcast by the planner, else a hot group's rows can be split, as the join has no aggregate beside it.
    group = written(group.select("g_lang", "g_source", *(use(n).alias(n) for n in names)), "thresholds")
    judged = features.join(group, ["g_lang", "g_source"], "left")
    beyond = [F.col(k) > F.col(f"t_{k}") for k in _FEATURES] + [F.col(k) < F.col(f"b_{k}") for k in BOTH_SIDES]
    out = F.lit(False)
    for b in beyond:
        out = out | F.coalesce(b, F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~out).alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    word, names = r"'[^\x20\x09-\x0D]+'", list(_FEATURES)
    sketch = lambda by: f"SELECT {by}feature, CASE WHEN value <= 0 THEN -1 ELSE ceil(ln(value) / ln({GAMMA})) END AS bucket, count(*) AS n FROM v GROUP BY ALL"

    def fences(by: str) -> str:
        group = f"PARTITION BY {by}feature"
        placed = f"SELECT *, sum(n) OVER ({group} ORDER BY bucket) AS upto, sum(n) OVER ({group}) AS texts FROM ({sketch(by)})"
        value = f"CASE WHEN bucket < 0 THEN 0 ELSE pow({GAMMA}, bucket - 0.5) END"
        at = ", ".join(f"min({value}) FILTER (upto * 100 >= texts * {q}) AS q{q}" for q in (25, 50, 90, 99))
        quantiles = f"SELECT {by}feature, max(texts) AS texts, {at} FROM ({placed}) GROUP BY ALL"
        high = "CASE WHEN q50 > q25 THEN q50 + 16 * (q50 - q25) WHEN q90 > q50 THEN q90 + 16 * (q90 - q50) ELSE q99 + 16 * (q99 - q50) END"
        low = "CASE WHEN q50 > q25 THEN q50 - 16 * (q50 - q25) END"
        each = ", ".join(f"max({high}) FILTER (feature = '{k}') AS t_{k}" for k in names)
        return f"SELECT {by}max(texts) AS texts, {each}, max({low}) FILTER (feature = 'word_length') AS b_word_length FROM ({quantiles}) GROUP BY ALL"

    pick = lambda c: f"CASE WHEN o.texts >= 50 THEN o.{c} WHEN l.texts >= 50 THEN l.{c} ELSE a.{c} END"
    values = ", ".join(f"{_FEATURES[k].replace(' div ', ' // ')} AS {k}" for k in names)
    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(lang, chr(1)) AS g_lang, coalesce(source, chr(1)) AS g_source, coalesce(text, '') AS x FROM documents),
w AS MATERIALIZED (SELECT *, regexp_extract_all(x, {word}) AS w FROM t),
q AS (SELECT id, i, count(*) OVER (PARTITION BY id, a, b, c) AS times FROM (SELECT id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
rep AS (SELECT id, count(DISTINCT j) AS n_repeat_words FROM (SELECT id, unnest([i, i + 1, i + 2]) AS j FROM q WHERE times > 1) GROUP BY 1),
lin AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT id, unnest(string_split(x, chr(10))) AS line FROM t) WHERE regexp_matches(line, {word}) GROUP BY 1),
c AS MATERIALIZED (SELECT id, doc_id, g_lang, g_source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(x, '[A-Z]')) AS n_upper,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (id) LEFT JOIN lin USING (id)),
f AS MATERIALIZED (SELECT *, {values}, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM c),
v AS MATERIALIZED (FROM (SELECT g_lang, g_source, {", ".join(names)} FROM f WHERE NOT base_failed) UNPIVOT (value FOR feature IN ({", ".join(names)}))),
o AS ({fences("g_lang, g_source, ")}), l AS ({fences("g_lang, ")}), a AS ({fences("")})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"f.{k} <= {pick(f't_{k}')}" for k in names)} AND coalesce(f.word_length >= {pick("b_word_length")}, true) AS kept
FROM f LEFT JOIN o USING (g_lang, g_source) LEFT JOIN l USING (g_lang), a"""


ORACLE = _oracle()
