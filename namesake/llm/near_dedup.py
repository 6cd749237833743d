"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._components import components
from ._store import discard, written
from ._superminhash import packed, signatures

#: 32 bands of 4 values: a pair at similarity 0.75 shares no bucket with probability 5e-6, at 0.8 with 5e-8.
BANDS, ROWS = 32, 4
WIDTH, SIMILARITY = 5, 75
#: Members of a component that each document of a shared bucket is held against before the exhaustive round.
LEADERS = 16
#: Blocks of hash values by which shingles are counted, to bound what two texts can share.
BLOCKS = 128


def _sets(width: int, texts: B.Texts) -> Iterator[list[np.ndarray]]:
    for i, j in B.chunks(texts):
        yield B.shingles_of(*B.words_of(texts[i:j], lower=True), width)


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = B.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            n, digests, keys = [], [], []
            for sets in _sets(width, B.Texts(batch.column("text"))):
                values = packed(signatures(sets, bands * rows)).astype(np.uint64).reshape(len(sets), bands, rows)
                key = salt
                for r in range(rows):
                    key = B.mix(key ^ values[:, :, r])
                n += map(len, sets)
                digests += map(_digest, sets)
                keys += [k.tobytes() if len(s) else None for k, s in zip(key, sets, strict=True)]
            flat = pa.array(np.frombuffer(b"".join(k for k in keys if k), np.int64))
            offsets = np.concatenate(([0], np.cumsum([bands if k else 0 for k in keys]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                ["doc_id", "text_hash", "n_shingles", "digest", "keys"],
            )

    return run


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in _sets(width, B.Texts(batch.column("text"))):
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                blocks = [np.bincount((s & np.uint64(BLOCKS - 1)).astype(np.int64), minlength=BLOCKS) for s in sets]
                blocks = pa.array([b.astype(np.int16) if b.max() < 1 << 15 else None for b in blocks], pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([pa.array(list(map(_digest, sets)), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat), blocks], ["digest", "shingles", "blocks"])

    return run


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS, with_hash: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    A text's set holds its distinct ``width``-word shingles (ASCII letters in lower case; a shorter text is one shingle).
    Two texts are linked where 100 * |A & B| >= similarity * |A | B|, confirmed on the full sets; component_id is the least
    doc_id that can be reached, kept says that it is the row's own.

    * Rows with equal sets are one node from the start, so copies never meet as pairs.
    * A bucket never emits its pairs. First each member meets two members of its bucket, one of them the member with the most
      company; then members outside the bucket's main component meet ``LEADERS`` members of that component. Only what is
      still apart meets the others of its buckets, where counts allow a link: with h of its n shingles held by any other
      node at hand, a text shares at most h; and two texts share no more of a block of hash values than either has there. A pair
      whose bounds stay below similarity is out.
      This last step makes the result whole: two members of a bucket that are linked end in one component.
    * Null or wordless texts have an empty set, no link, and are kept. Rows without doc_id are linked like others; component_id
      is null where no row of the component has one, and there the rows of the text with the least hash are kept. Rows with one doc_id
      and several texts are grouped by each text. Other columns are not read.
    * ``with_hash`` adds text_hash, which with doc_id names the row, and first: whether that is the component's least name
      (true without a set). Kept rows of one doc_id may have several names, and repeated rows share theirs.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = written(
        source.mapInArrow(B.lean(_sign(width, bands, rows)), "doc_id long, text_hash long, n_shingles long, digest binary, keys array<long>"), "signatures"
    )
    # A row's name; those without doc_id come last.
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), "text_hash")
    named = signed.filter("digest is not null").select("digest", "keys", name.alias("first"))
    nodes = named.groupBy("digest").agg(F.min("first").alias("first"))
    firsts = named.join(nodes, ["digest", "first"], "left_semi").dropDuplicates(["digest"])

    entries = firsts.select("digest", "first", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").count().filter("count > 1")
    buckets = written(entries.join(shared, "key").select("key", "digest", "first", "count"), "buckets")
    # How much company a node has in its buckets: the original of many edited copies has the most.
    company = buckets.groupBy("digest").agg(F.sum("count").alias("company"), F.array_sort(F.collect_list("key")).alias("keys"))

    wanted = buckets.select("first.*").distinct()
    sets = source.select(name.alias("name"), "text").select("name.*", "text").join(wanted, ["none", "id", "text_hash"], "left_semi").select("text")
    sets = written(sets.mapInArrow(B.lean(_shingle_sets(width)), "digest binary, shingles array<long>, blocks array<smallint>").dropDuplicates(["digest"]), "sets")

    whole = sets.select("digest", "shingles")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()
        both = pairs.join(whole.toDF("a", "sa"), "a").join(whole.toDF("b", "sb"), "b")
        size = F.size("sa") + F.size("sb")
        near = F.least(F.size("sa"), F.size("sb")) * 100 >= similarity * F.greatest(F.size("sa"), F.size("sb"))
        common = F.when(near, F.size(F.array_intersect("sa", "sb"))).otherwise(0)
        return both.filter(common * (100 + similarity) >= similarity * size).select("a", "b")

    ranked = buckets.join(company.select("digest", "company"), "digest")
    ends = ranked.groupBy("key").agg(F.max(F.struct("company", "digest")).alias("x"), F.min(F.struct(F.xxhash64("digest"), "digest")).alias("y"))
    met = buckets.join(ends, "key").select(F.col("digest").alias("a"), F.explode(F.array("x.digest", "y.digest")).alias("b"))
    links = written(linked(met), "verified")

    def labelled(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Labels of linked nodes, and the buckets that still hold several components, with each one's size there."""
        labels = components(links)
        rows_ = buckets.join(labels, buckets.digest == labels.node, "left").select("key", "digest", F.coalesce("label", "digest").alias("label"))
        per = rows_.groupBy("key", "label").agg(F.count("*").alias("n"))
        main = per.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("main")).filter("labels > 1")
        return labels, rows_.join(main.select("key", F.col("main.label").alias("main")), "key")

    labels, apart = labelled(links)
    apart = written(apart, "apart")
    leaders = _central(labels.join(company, labels.node == company.digest), LEADERS)
    outside = apart.filter("label != main").select("digest", "main").distinct()
    met = outside.join(leaders, outside.main == leaders.label).select(F.col("digest").alias("a"), F.explode("of").alias("b"))
    before = (links, labels, apart)
    links = written(links.unionByName(linked(met)), "verified")
    discard(*before)

    labels, apart = labelled(links)
    apart = written(apart, "apart")
    held = sets.join(apart.select("digest").distinct(), "digest", "left_semi")
    alone = held.select(F.xxhash64("digest").alias("owner"), F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("owner").alias("owner"))
    alone = alone.filter("n = 1").groupBy("owner").agg(F.count("*").alias("alone"))
    able = held.select("digest", "blocks", F.size("shingles").alias("n")).join(alone, F.xxhash64("digest") == F.col("owner"), "left")
    able = able.select("digest", "blocks", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("held")).filter(F.col("held") * 100 >= similarity * F.col("n"))
    able = written(apart.join(able, "digest").join(company.select("digest", "keys"), "digest"), "able")
    near = f"100 * least(l.held, r.held) >= {similarity} * (l.n + r.n - least(l.held, r.held))"
    once = "array_min(array_intersect(l.keys, r.keys)) = l.key"
    shared = "aggregate(zip_with(l.blocks, r.blocks, (x, y) -> least(x, y)), 0, (s, x) -> s + x)"
    may = f"coalesce({shared} * {100 + similarity} >= {similarity} * (l.n + r.n), true)"
    left, right = able.filter("label != main").alias("l"), able.alias("r")
    met = left.join(right, F.expr(f"l.key = r.key and l.label != r.label and {near} and {once} and {may}")).select(F.col("l.digest").alias("a"), F.col("r.digest").alias("b"))
    before = (links, labels, apart, able)
    links = written(links.unionByName(linked(met)), "verified")
    discard(*before, sets, buckets)

    labels = components(links)
    discard(links)
    linked_nodes = nodes.join(labels, nodes.digest == labels.node).select("digest", "label", F.col("first").alias("root"))
    least = linked_nodes.groupBy("label").agg(F.min("root").alias("least"))
    moved = linked_nodes.join(least, "label").select("digest", "least")
    classes = nodes.join(moved, "digest", "left").select("digest", F.coalesce("least", "first").alias("class"))
    classes = written(classes, "classes")  # so that adaptive execution can split a set that a third of the rows have
    found = signed.select("doc_id", "n_shingles", "digest", "text_hash").join(classes, "digest", "left")
    component = F.when(F.col("class.none"), None).otherwise(F.coalesce("class.id", "doc_id"))
    first = F.coalesce(name == F.col("class"), F.lit(True))
    kept = F.when(component.isNull(), first).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False)))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), *["text_hash", first.alias("first")] * with_hash)


def _central(members: DataFrame, k: int) -> DataFrame:
    """``label, of``: up to ``k`` members of each component, the one with the most company from each of ``k`` slices by hash."""
    most = members.groupBy("label", F.pmod(F.xxhash64("node"), F.lit(k)).alias("slice")).agg(F.max(F.struct("company", "node")).alias("m"))
    return most.groupBy("label").agg(F.collect_list("m.node").alias("of"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by joining all shingles, for small tables.
ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {SIMILARITY} * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT doc_id, doc_id FROM documents),
r AS (SELECT a AS doc_id, b AS c FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n"""
