"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits, in DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: 256 bins of 4 bits: a fingerprint is 128 bytes, a hexadecimal digit for each bin.
BINS, BITS = 256, 4
WIDTH = 5
#: Draws of a donor for an empty bin before the exact search among all filled bins.
DRAWS = 8
_SPACE = " \t\n\x0b\f\r"


def _bin(x: str) -> str:
    return f"cast(shiftright({x}, 56) + 128 as int)"


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with column ``out``: one low-order value for each bin, or null where ``text`` has no words.

    Every shingle of ``WIDTH`` words (lower case, split at white space; fewer words are one shingle) is hashed once. The top
    8 bits choose its bin, which keeps its least hash. An empty bin takes the value of a filled one: it draws bins
    from a hash of its own number until one is filled, the same draws for every text, so equal bins stay equal. After
    ``DRAWS`` misses the filled bin of least hash with the empty one's number is taken, which any number of draws ends in.
    """
    words, hashes, least, filled = f"{out}_words", f"{out}_hashes", f"{out}_least", f"{out}_filled"
    clean = F.trim(F.lower(F.col(text)), F.lit(_SPACE))
    df = df.withColumn(words, F.when(clean != "", F.split(clean, r"[\x20\x09-\x0D]+")))
    df = df.withColumn(hashes, F.expr(f"case when size({words}) < {WIDTH} then array(xxhash64({words})) else sort_array(transform(sequence(1, size({words}) - {WIDTH - 1}), i -> xxhash64(slice({words}, i, {WIDTH})))) end")).drop(words)
    df = df.withColumn(least, F.expr(f"filter({hashes}, (x, i) -> i = 0 or shiftright(x, 56) <> shiftright({hashes}[i - 1], 56))")).drop(hashes)
    gap = f"{_bin('x')} - if(k = 0, -1, {_bin(f'{least}[k - 1]')}) - 1"
    value = f"cast(x & {(1 << BITS) - 1} as tinyint)"
    tail = f"array_repeat(cast(null as tinyint), {BINS - 1} - {_bin(f'element_at({least}, -1)')})"
    df = df.withColumn(filled, F.expr(f"concat(flatten(transform({least}, (x, k) -> concat(array_repeat(cast(null as tinyint), {gap}), array({value})))), {tail})"))
    draws = ", ".join(f"{filled}[cast(pmod(xxhash64(i, {d}), {BINS}) as int)]" for d in range(DRAWS))
    search = f"array_min(transform({least}, x -> struct(xxhash64(i, {_bin('x')}) as o, {value} as v))).v"
    return df.withColumn(out, F.expr(f"transform({filled}, (b, i) -> coalesce(b, {draws}, {search}))")).drop(least, filled)


def packed(values: str) -> Column:
    """The low-order bits of all bins as hexadecimal digits, the empty string where there are no words."""
    return F.expr(f"coalesce(array_join(transform({values}, v -> lower(hex(v))), ''), '')")


def likeness(a: str, b: str) -> Column:
    """Estimated similarity of two texts' shingle sets: agreement of bins, less the part that chance gives to ``BITS`` bits.

    1 where neither has words, 0 where one has none.
    """
    chance = 1 / (1 << BITS)
    agree = F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), z -> z))") / float(BINS)
    estimate = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (agree - chance) / (1 - chance)))
    return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(estimate)


def with_next(df: DataFrame, order: list[str], columns: list[str], prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``prepare(df)`` with struct ``next`` of ``columns`` of the following row by ``order`` (the first row's after the last).

    Rows go once to a range of ``order[0]`` and are walked within it; the first row of each range, one row a range,
    is prepared by itself and joined to the last row of the range before. Its key is broadcast to find it: as many keys as there are
    shuffle partitions, at most. Ranges come from approximate quantiles, two levels of at
    most a hundred, so no task holds more than its share. Nulls come first, ties follow the rest of ``order``.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(order[0], [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    cuts = sorted(set(cuts or []))
    step = max(1, round(len(cuts) ** 0.5))
    levels = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if cuts:
        upper = F.size(F.filter(F.array(*(F.lit(level[0]) for level in levels)), lambda c: F.col(order[0]) >= c))
        table = F.array(*(F.array(*map(F.lit, level)) for level in levels))
        lower = F.size(F.filter(table[F.greatest(upper - 1, F.lit(0))], lambda c: F.col(order[0]) >= c))
        part = F.when(F.col(order[0]).isNull() | (upper == 0), 0).otherwise((upper - 1) * step + lower)
    else:
        part = F.lit(0)
    dealt = df.withColumn("_part", part.cast("int"))
    keys = dealt.select("_part", F.struct(*order).alias("_key"))
    first = keys.groupBy("_part").agg(F.min("_key").alias("_key"))
    every = Window.orderBy("_part")  # one row for each range
    wrapped = first.select(F.lag("_part").over(every).alias("_before"), "_part", F.max("_part").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_end"), "_key")
    heads = wrapped.select(F.coalesce("_before", "_end").alias("_to"), F.col("_key"))
    found = dealt.join(F.broadcast(heads), F.struct(*(dealt[c] for c in order)).eqNullSafe(heads["_key"])).dropDuplicates(["_to"])
    head_rows = prepare(found).select("_to", F.struct(*columns).alias("_head"))
    walk = Window.partitionBy("_part").orderBy(*order)
    walked = prepare(dealt).withColumn("_next", F.lead(F.struct(*columns)).over(walk))
    joined = walked.join(head_rows, walked["_part"] == head_rows["_to"], "left")
    return joined.withColumn("next", F.coalesce("_next", "_head")).drop("_part", "_next", "_to", "_head")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row of
    ``docs(doc_id, text)``.

    The edited text has the last floor(n / 2) code points of a text of n replaced by the first as many (or all) of the next
    document's, by ascending doc_id, then by hash of the text; the last is followed by the first, a single row by itself.
    Null is the empty text; a text without words has an empty fingerprint. Other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    paired = with_next(source, ["doc_id", "tie"], ["text", "own"], lambda df: with_fingerprint(df, "text", "own"))
    n = F.char_length("text")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - char_length(text) div 2)"), F.expr("substring(next.text, 1, cast(char_length(text) div 2 as int))"))
    both = with_fingerprint(paired.select("doc_id", n.cast("long").alias("n_chars"), "own", F.col("next.own").alias("following"), edited.alias("edited")), "edited", "other")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed("own").alias("fingerprint"), packed("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"), likeness("own", "following").alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
