"""Distances and features of all pairs of a block, tile by tile: what a pair needs travels with its articles, not with the pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .distance import KINDS
from .features import FEATURES

#: Articles of a tile's side, on the average.
SIDE = 512
#: Pairs of an Arrow batch.
ROWS = 1 << 16
#: A shared token goes through the matrix product if its pairs are more than one in so many of the tile's.
DENSE = 64
_WIDTH = 2048
_SLAB = 1 << 21


def common_counts(na: int, row_a: np.ndarray, item_a: np.ndarray, nb: int, row_b: np.ndarray, item_b: np.ndarray) -> np.ndarray:
    """``na x nb``: the number of items that row i of one side and row j of the other have in common; a row has an item once."""
    out = np.zeros(na * nb)
    unique_a, code_a = np.unique(item_a, return_inverse=True)
    unique_b, code_b = np.unique(item_b, return_inverse=True)
    _, in_a, in_b = np.intersect1d(unique_a, unique_b, assume_unique=True, return_indices=True)
    n = len(in_a)
    if not n:
        return out.reshape(na, nb)

    def kept(unique: np.ndarray, code: np.ndarray, row: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows in order of their items, how many each item has, and where they begin."""
        to = np.full(len(unique), -1)
        to[places] = np.arange(n)
        item = to[code]
        row, item = row[item >= 0], item[item >= 0]
        count = np.bincount(item, minlength=n)
        return row[np.argsort(item, kind="stable")], count, np.cumsum(count) - count

    row_a, count_a, begin_a = kept(unique_a, code_a, row_a, in_a)
    row_b, count_b, begin_b = kept(unique_b, code_b, row_b, in_b)
    dense = count_a * count_b * DENSE > na * nb
    number = np.cumsum(dense) - 1
    item_a, item_b = np.repeat(np.arange(n), count_a), np.repeat(np.arange(n), count_b)
    of_a, of_b = dense[item_a], dense[item_b]
    ra, ca, rb, cb = row_a[of_a], number[item_a[of_a]], row_b[of_b], number[item_b[of_b]]
    for first in range(0, int(dense.sum()), _WIDTH):
        sides = []
        for size, row, column in ((na, ra, ca), (nb, rb, cb)):
            x, y = np.searchsorted(column, (first, first + _WIDTH))
            side = np.zeros((size, _WIDTH), np.float32)
            side[row[x:y], column[x:y] - first] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).ravel()
    left, item = row_a[~of_a], item_a[~of_a]
    times = count_b[item]
    upto = np.cumsum(times)
    x = 0
    while x < len(left):
        y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + _SLAB, side="right")))
        t = times[x:y]
        ends = np.cumsum(t)
        at = np.repeat(begin_b[item[x:y]] - (ends - t), t) + np.arange(ends[-1])
        out += np.bincount(np.repeat(left[x:y] * nb, t) + row_b[at], minlength=na * nb)
        x = y
    return out.reshape(na, nb)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a list column: row of each element, length of each row, elements; a null is an empty list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), size, 0)
    return np.repeat(np.arange(len(column)), size), size, column.flatten()


class _Side:
    """The articles of one side of a tile."""

    def __init__(self, rows: pa.Table, kinds: tuple[str, ...]):
        self.n = len(rows)
        self.id = rows.column("id").combine_chunks()
        self.items = {k: (row, size, items.to_numpy()) for k in kinds for row, size, items in (_flat(rows.column(k)),)}
        self.rows = rows


def _distances(a: _Side, b: _Side, kinds: tuple[str, ...]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """By kind: 1 - sum(min) / sum(max) of each pair, and which pairs have tokens on both sides."""
    dist, known = {}, {}
    for k in kinds:
        (ra, na, xa), (rb, nb, xb) = a.items[k], b.items[k]
        c = common_counts(a.n, ra, xa, b.n, rb, xb)
        known[k] = (na[:, None] > 0) & (nb[None, :] > 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            dist[k] = 1 - c / (na[:, None] + nb[None, :] - c)
    return dist, known


def _article_pairs(a: _Side, b: _Side, same: bool, kinds: tuple[str, ...], classes: pa.Table | None) -> Iterator[pa.RecordBatch]:
    """``id1, id2, dist_<kind>``: each unordered pair, in the least block that the two articles share."""
    (ra, _, xa), (rb, _, xb) = _flat(a.rows.column("before")), _flat(b.rows.column("before"))
    code = pa.concat_arrays([xa, xb]).dictionary_encode().indices.to_numpy()
    here = common_counts(a.n, ra, code[: len(xa)], b.n, rb, code[len(xa) :]) == 0
    if same:
        here &= np.tri(a.n, k=-1, dtype=bool).T
    mine_a, mine_b = (x.rows.column("mine").to_numpy() for x in (a, b))
    i, j = np.nonzero(here & (mine_a[:, None] | mine_b[None, :]))
    if not len(i):
        return
    dist, known = _distances(a, b, kinds)
    ids_a, ids_b = a.id.to_numpy(), b.id.to_numpy()
    for x in range(0, len(i), ROWS):
        p, q = i[x : x + ROWS], j[x : x + ROWS]
        one, two = ids_a[p], ids_b[q]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), *(pa.array(dist[k][p, q], mask=~known[k][p, q]) for k in kinds)], ["id1", "id2", *(f"dist_{k}" for k in kinds)])


def _coded(*columns: pa.Array) -> list[np.ndarray]:
    """Numbers for the values of columns, equal for equal ones in any of them, -1 for null."""
    whole = pa.concat_arrays(columns).dictionary_encode().indices.fill_null(-1).to_numpy()
    return np.split(whole, np.cumsum([len(c) for c in columns])[:-1])


def _class_table(sa: pa.StructArray, sb: pa.StructArray, classes: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the last names of both sides, and the class distance of each two numbers; -1, the last one, is no name."""
    name_a, name_b, c1, c2 = _coded(sa.field("last_name"), sb.field("last_name"), classes.column("last_name_1").combine_chunks(), classes.column("last_name_2").combine_chunks())
    table = np.ones((max(x.max(initial=-1) for x in (name_a, name_b, c1, c2)) + 2,) * 2)
    table[c1, c2] = classes.column("dist").combine_chunks().fill_null(1.0).to_numpy()
    return name_a, name_b, table


def _signature_pairs(a: _Side, b: _Side, same: bool, kinds: tuple[str, ...], classes: pa.Table | None) -> Iterator[pa.RecordBatch]:
    """Ordered pairs of signatures with their features, those whose first article is ``mine``."""
    (of_a, _, sa), (of_b, _, sb) = _flat(a.rows.column("sigs")), _flat(b.rows.column("sigs"))
    if not len(sa) or not len(sb):
        return
    dist, known = _distances(a, b, kinds)
    dist = {k: np.where(known[k], dist[k], 1.0) for k in kinds}
    mine_a, mine_b = (x.rows.column("mine").to_numpy() for x in (a, b))
    ids_a, ids_b = a.id.to_numpy(), b.id.to_numpy()
    codes = {f: _coded(sa.field(f), sb.field(f)) for f in ("d", "fn_initial", "mn_initial", "topic")}
    years = [(s.field("year").fill_null(0).to_numpy(), s.field("year").is_valid().to_numpy(zero_copy_only=False)) for s in (sa, sb)]
    ethnic = None
    if classes is not None:
        name_a, name_b, ethnic = _class_table(sa, sb, classes)
    focus = a.rows.column("focus_name")[0]

    def made(p: np.ndarray, q: np.ndarray, turned: bool) -> pa.RecordBatch:
        i, j = of_a[p], of_b[q]
        one, two = (ids_a[i], sa.field("d").take(pa.array(p))), (ids_b[j], sb.field("d").take(pa.array(q)))
        if turned:
            one, two = two, one
        equal = {f: pa.array(((x[p] == y[q]) & (x[p] >= 0)).astype(np.int32)) for f, (x, y) in codes.items()}
        apart = ids_a[i] != ids_b[j]
        columns = {"id1": pa.array(one[0]), "d1": one[1], "id2": pa.array(two[0]), "d2": two[1], "focus_name": pa.repeat(focus, len(p))}
        columns |= {"eq_fn_initial": equal["fn_initial"], "eq_mn_initial": equal["mn_initial"], "eq_lda_topic": equal["topic"]}
        columns["diff_year"] = pa.array(np.abs(years[0][0][p] - years[1][0][q]), mask=~(years[0][1][p] & years[1][1][q]))
        columns |= {f"dist_{k}": pa.array(np.where(apart, dist[k][i, j], 0.0)) for k in kinds}
        if ethnic is not None:
            e = ethnic[name_b[q], name_a[p]] if turned else ethnic[name_a[p], name_b[q]]
            columns["dist_ethnicity"] = pa.array(e)
        return pa.RecordBatch.from_pydict(columns)

    step = max(1, ROWS // len(sb))
    for x in range(0, len(sa), step):
        p = np.repeat(np.arange(x, min(x + step, len(sa))), len(sb))
        q = np.tile(np.arange(len(sb)), len(p) // len(sb))
        if same:
            ok = mine_a[of_a[p]] & ((ids_a[of_a[p]] != ids_b[of_b[q]]) | (codes["d"][0][p] != codes["d"][1][q]))
            if ok.any():
                yield made(p[ok], q[ok], False)
            continue
        for turned, ok in ((False, mine_a[of_a[p]]), (True, mine_b[of_b[q]])):
            if ok.any():
                yield made(p[ok], q[ok], turned)


def _each_tile(kinds: tuple[str, ...], pairs: Callable, with_classes: bool):
    """Calls ``pairs`` with both sides of every tile; rows come sorted by tile, those with no side are the tile's class distances."""

    def tile(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        side, i, j = rows.column("side").fill_null(-1).to_numpy(), rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        a, b = (_Side(rows.filter(pa.array(side == k)), kinds) for k in (i, j))
        classes = None
        if with_classes:
            found = rows.column("classes").combine_chunks().flatten()
            classes = pa.table([found.field(k) for k in range(3)], ["last_name_1", "last_name_2", "dist"])
        if a.n and b.n:
            yield from pairs(a, b, i == j, kinds, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column("focus_name").dictionary_encode().indices.to_numpy()
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            new = np.flatnonzero((code[1:] != code[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for x, y in zip([0, *new.tolist()], [*new.tolist(), len(code)], strict=True):
                key = (batch.column("focus_name")[x].as_py(), i[x], j[x])
                if held and key != last:
                    yield from tile(pa.Table.from_batches(held))
                    held = []
                last = key
                held.append(batch.slice(x, y - x))
        if held:
            yield from tile(pa.Table.from_batches(held))

    return run


def _tiled(members: DataFrame, items: DataFrame, several: str, classes: DataFrame | None, side: int | None = None) -> DataFrame:
    """``members(focus_name, id, mine, ...)``, one row for each article of a block, dealt to the tiles (i, j) of its block, with its items.

    Articles are in sides of some ``side`` (``SIDE``), those that are ``mine`` in the first ones; a tile is a pair of sides i <= j with i among these.
    Blocks for which ``several`` does not hold are left out.
    """
    sides = lambda mine: F.ceil(F.sum(F.when(mine, 1).otherwise(0)) / (side or SIDE)).cast("int")
    blocks = members.groupBy("focus_name").agg(sides(F.col("mine")).alias("n_mine"), sides(~F.col("mine")).alias("n_rest"), F.expr(several).alias("several"))
    blocks = blocks.filter("n_mine > 0 and several").drop("several")
    own = F.when(F.col("mine"), F.pmod(F.xxhash64("id"), F.col("n_mine"))).otherwise(F.col("n_mine") + F.pmod(F.xxhash64("id"), F.col("n_rest"))).cast("int")
    dealt = members.join(blocks, "focus_name").withColumn("side", own)
    others = F.sequence(F.lit(0), F.col("n_mine") + F.col("n_rest") - 1)
    tile = F.filter(F.transform(others, lambda u: F.struct(F.least("side", u).alias("i"), F.greatest("side", u).alias("j"))), lambda t: t["i"] < F.col("n_mine"))
    rows = dealt.withColumn("tile", F.explode(tile)).select("*", "tile.i", "tile.j").drop("tile", "n_mine", "n_rest").join(items, "id", "left")
    if classes is not None:
        n = F.col("n_mine") + F.col("n_rest")
        every = F.flatten(F.transform(F.sequence(F.lit(0), F.col("n_mine") - 1), lambda i: F.transform(F.sequence(i, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
        tiles = blocks.select("focus_name", F.explode(every).alias("tile")).select("focus_name", "tile.i", "tile.j")
        rows = rows.unionByName(tiles.join(classes, "focus_name"), allowMissingColumns=True)
    return rows.repartition("focus_name", "i", "j").sortWithinPartitions("focus_name", "i", "j")


def _items(counts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``id`` and, by kind, the article's tokens as 64-bit hashes; the n-th of equal tokens is an item of its own."""
    item = F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.xxhash64("token", k)))
    return counts.select("kind", "id", item.alias("item")).groupBy("id").agg(*(F.collect_list(F.when(F.col("kind") == k, F.col("item"))).alias(k) for k in kinds))


def article_distances(signatures: DataFrame, counts: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``id1, id2, dist_<kind>``: each unordered pair of articles id1 < id2 that share a block key; null where a kind is missing on a side.

    The same as ``wide(multiset_jaccard(counts, article_pairs(candidate_pairs(signatures, signatures))))`` for integer ids, where both have tokens of a kind.
    """
    s = signatures.select("focus_name", F.col("id").cast("long").alias("id")).filter("focus_name is not null and id is not null").distinct()
    keys = F.collect_set("focus_name").over(Window.partitionBy("id"))
    members = s.withColumn("keys", keys).select("focus_name", "id", F.lit(True).alias("mine"), F.filter("keys", lambda k: k < F.col("focus_name")).alias("before"))
    rows = _tiled(members, _items(counts, kinds), "count(*) > 1", None)
    schema = ", ".join(["id1 long, id2 long", *(f"dist_{k} double" for k in kinds)])
    return rows.select("focus_name", "i", "j", "side", "id", "mine", "before", *kinds).mapInArrow(_each_tile(kinds, _article_pairs, False), schema)


def signature_tiles(batch: DataFrame | None, signatures: DataFrame, articles: DataFrame, topics: DataFrame, counts: DataFrame, classes: DataFrame | None, side: int | None = None) -> DataFrame:
    """The articles of each block with their signatures and items (and the block's class distances), dealt to tiles."""
    mine = signatures.select("id").distinct().withColumn("mine", F.lit(True)) if batch is None else batch.select("id").distinct().withColumn("mine", F.lit(True))
    sides = signatures.select("id", "d", "last_name", "fn_initial", "mn_initial").join(articles.select("id", "year"), "id").join(topics.select("id", "topic"), "id")
    each = signatures.select("id", "d", "focus_name").filter("focus_name is not null").join(sides, ["id", "d"]).join(mine, "id", "left")
    sig = F.struct("d", "last_name", "fn_initial", "mn_initial", F.col("year").cast("long").alias("year"), "topic")
    members = each.groupBy("focus_name", F.col("id").cast("long").alias("id")).agg(F.coalesce(F.max("mine"), F.lit(False)).alias("mine"), F.collect_list(sig).alias("sigs"))
    given = None
    if classes is not None:
        kept = classes.groupBy("last_name_1", "last_name_2").agg(F.min("dist").alias("dist"))
        names = each.select("focus_name", "last_name").distinct()
        named = lambda k: names.withColumnRenamed("last_name", f"last_name_{k}")
        met = kept.join(named(1), "last_name_1").join(named(2), ["focus_name", "last_name_2"])
        given = met.groupBy("focus_name").agg(F.collect_list(F.struct("last_name_1", "last_name_2", "dist")).alias("classes"))
    rows = _tiled(members, _items(counts, KINDS), "sum(size(sigs)) > 1", given, side)
    return rows.select("focus_name", "i", "j", "side", "id", "mine", "sigs", *KINDS, *["classes"] * (given is not None))


def of_features(tiles: DataFrame, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``then`` makes, within a task, of the batches of ``id1, d1, id2, d2, focus_name`` and features of the pairs of ``signature_tiles``; without class distances there is no ``dist_ethnicity``."""
    each = _each_tile(KINDS, _signature_pairs, "classes" in tiles.columns)
    return tiles.mapInArrow(lambda batches: then(each(batches)), schema)


def block_features(batch: DataFrame | None, signatures: DataFrame, articles: DataFrame, topics: DataFrame, counts: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``id1, d1, id2, d2, focus_name`` and the features of all candidate pairs whose first article is in ``batch(id)``, or of all.

    The same as ``pair_features`` over ``candidate_pairs``, for integer ids: repeated rows of signatures, articles or topics
    multiply pairs, missing distances are 1. No pair is shuffled.
    """
    rows = signature_tiles(batch, signatures, articles, topics, counts, classes)
    id_type, d_type, year_type = (t.schema[c].dataType.simpleString() for t, c in ((signatures, "id"), (signatures, "d"), (articles, "year")))
    schema = f"id1 long, d1 {d_type}, id2 long, d2 {d_type}, focus_name string, eq_fn_initial int, eq_mn_initial int, eq_lda_topic int, diff_year long, " + ", ".join(f"dist_{k} double" for k in KINDS)
    made = rows.mapInArrow(_each_tile(KINDS, _signature_pairs, classes is not None), schema + ", dist_ethnicity double" * (classes is not None))
    cast = {"id1": id_type, "id2": id_type, "diff_year": year_type}
    made = made.withColumns({c: F.col(c).cast(t) for c, t in cast.items()})
    made = made if classes is not None else made.withColumn("dist_ethnicity", F.lit(1.0))
    return made.select("id1", "d1", "id2", "d2", "focus_name", *FEATURES)
