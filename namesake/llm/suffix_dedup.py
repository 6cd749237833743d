"""Removal of repeated passages: depth-limited most-significant-digit radix passes over the suffixes of whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._store import written

DEPTH = 200
#: Bytes of the first digit.
GRAM = 48
#: Runs of one first digit that a task sorts together; the runs of a more common one get a longer first digit.
TOGETHER = 1024
#: Windows of a run that share a longer first digit, pass by pass; a digit of one window is the window.
NARROWER = (19, 3, 1)
#: Bytes of runs that a task sorts at a time, whole groups.
SLAB = 4 << 20
_NO_ID = -(1 << 63)
#: Bits of a place in a chunk, which holds at most twice ``CHUNK`` bytes and a few windows.
_PLACE_BITS = 21
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _least_in_windows(key: np.ndarray, width: int) -> np.ndarray:
    size, low = 1, key
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(low) - (width - size)], low[width - size :]) if width > size else low


_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _order(buf: np.ndarray, gram: int) -> np.ndarray:
    """A number for the gram at each place, the same wherever it stands, by which grams are ordered; it proves nothing equal."""
    n = len(buf)
    if len(_powers[0]) <= n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.full(1 << n.bit_length(), b, _U)
            _powers[k][0] = 1
            np.multiply.accumulate(_powers[k], out=_powers[k])
    sums = np.zeros(n + 1, _U)
    np.cumsum(B.mix(np.arange(1, 257, dtype=_U))[buf] * _powers[0][:n], out=sums[1:])
    return B.mix((sums[gram:] - sums[: n - gram + 1]) * _powers[1][: n - gram + 1])


class _Chunk:
    """Texts side by side, or one piece of a long text, with the suffixes that begin there, ``depth`` bytes of each.

    Suffixes are held in runs: all that follow one another and have their first digit in common, the gram of least
    ``_order`` among those that their bytes hold (the first of equals), at the run's anchor. Equal suffixes have equal
    digits at equal distances. A unit (place, low, high) is a run: its anchor, and the least and greatest distance to it.
    """

    def __init__(self, texts: list[bytes], depth: int, gram: int, offset: int = 0, head: int = 0, tail: int | None = None):
        self.depth, self.gram, self.offset, self.home = depth, gram, offset, (head, tail)
        self.buf, self.starts = B.joined(texts)

    def runs(self) -> tuple[np.ndarray, ...]:
        """Text number, anchor (in the buffer), low and high of every run."""
        n, (head, tail) = len(self.buf), self.home
        mark = np.zeros(n + 1, np.int32)
        first, last = self.starts[:-1] + head, self.starts[1:] - 1 - self.depth + 1
        if tail is not None:
            last = np.minimum(last, self.starts[:-1] + tail)
        some = last > first
        np.add.at(mark, first[some], 1)
        np.add.at(mark, last[some], -1)
        windows = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        if not len(windows):
            return windows, windows, windows, windows
        # The same number of bits in every chunk, so that orders tie alike wherever a window stands.
        bits = _U(max(_PLACE_BITS, (n - 1).bit_length()))
        key = _order(self.buf, self.gram)
        key = ((key >> bits) << bits) | np.arange(len(key), dtype=_U)
        anchor = (_least_in_windows(key, self.depth - self.gram + 1)[windows] & _U((1 << int(bits)) - 1)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        end = np.append(begin[1:], len(anchor)) - 1
        at = anchor[begin]
        return np.searchsorted(self.starts, at, side="right") - 1, at, at - windows[end], at - windows[begin]

    def given(self, units: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """The same for units of the texts, those whose anchor is at home in this piece."""
        head, tail = self.home
        text = np.repeat(np.arange(len(units)), [len(u) for u in units])
        unit = np.concatenate(units)
        at = (unit >> 16) - self.offset
        ok = (at >= head) & (at < (np.iinfo(np.int64).max if tail is None else tail))
        return text[ok], at[ok] + self.starts[text[ok]], unit[ok] >> 8 & 255, unit[ok] & 255

    def narrowed(self, text: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        """Runs cut where the distance to the anchor passes a multiple of ``width``."""
        parts = high // width - low // width + 1
        which = np.repeat(np.arange(len(at)), parts)
        t = low[which] // width + np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        return text[which], at[which], np.maximum(low[which], t * width), np.minimum(high[which], t * width + width - 1)

    def units(self, text: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, width: int | None) -> tuple[np.ndarray, ...]:
        """Text number, unit, hash of the first digit, and hash of all bytes of the run."""
        if width is None:
            group = B.span_hash(self.buf, at, at + self.gram)
        else:
            t = low // width
            group = B.mix(B.span_hash(self.buf, at - t * width, at + self.depth - (t * width + width - 1)) + (t * 256 + width).astype(_U))
        around = B.mix(B.span_hash(self.buf, at - high, at + self.depth - low) ^ B.mix((low * 256 + high).astype(_U)))
        return text, (at - self.starts[text] + self.offset) << 16 | low << 8 | high, group, around


def _pieces(texts: B.Texts | list[bytes], depth: int, gram: int) -> Iterator[tuple[int, int, _Chunk]]:
    """Chunks with the run [i, j) of texts that each holds; a long text comes in overlapping pieces."""
    for i, j in B.chunks(texts):
        own = texts[i:j]
        if j - i == 1 and len(own[0]) > 2 * B.CHUNK:
            for a in range(0, len(own[0]), B.CHUNK):
                begin = max(0, a - depth)
                yield i, j, _Chunk([own[0][begin : a + B.CHUNK + 2 * depth]], depth, gram, begin, a - begin, a - begin + B.CHUNK)
        else:
            yield i, j, _Chunk(own, depth, gram)


def _spread(group: np.ndarray, around: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have an equal in this batch, and where to send each: the first of equals to its group, others anywhere.

    Equals within a batch prove each other, so one of them is enough for the rest of the corpus, and a group
    that holds a third of all rows still sends one row a batch to the group's task.
    """
    _, first, inverse, count = np.unique(around, return_index=True, return_inverse=True, return_counts=True)
    doubtful = np.zeros(len(first), bool)
    doubtful[inverse[group != group[first][inverse]]] = True
    known = (count > 1)[inverse] & ~doubtful[inverse]
    extra = known & (first[inverse] != np.arange(len(around)))
    return known, np.where(extra, B.mix(salt ^ around), group)


def _split(group: np.ndarray, around: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows' first digit stands in different runs of this batch, and where to send each row.

    Such a digit needs no other batch to go on, so all but one of its rows meet their equals by ``around`` instead.
    """
    place = np.flatnonzero(to == group)
    _, first, inverse = np.unique(group[place], return_index=True, return_inverse=True)
    differs = np.zeros(len(first), bool)
    differs[inverse[around[place] != around[place][first][inverse]]] = True
    several = np.zeros(len(group), bool)
    several[place] = differs[inverse]
    moved = several.copy()
    moved[place[first]] = False
    return several, np.where(moved, B.mix(around), to)


_UNITS = "doc long, text_hash long, unit long, to long, gram long, around long, known boolean, several boolean"


def _lists(column) -> list[np.ndarray]:
    return [x.values.to_numpy() for x in column]


def _first_digits(depth: int, gram: int, width: int | None):
    """Rows of ``_UNITS``: every run of the texts, or, with a width, the narrower runs of the units in column units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text_hash = (batch.column(c).to_numpy() for c in ("doc", "text_hash"))
            given = _lists(batch.column("units")) if width else None
            parts = []
            for i, j, chunk in _pieces(B.Texts(batch.column("text")), depth, gram):
                found = chunk.narrowed(*chunk.given(given[i:j]), width) if given else chunk.runs()
                text, unit, group, around = chunk.units(*found, width)
                parts.append((doc[i + text], text_hash[i + text], unit, group, around))
            if not parts:
                continue
            d, h, unit, group, around = map(np.concatenate, zip(*parts, strict=True))
            known, to = _spread(group, around, B.mix(h.view(_U) + unit.astype(_U)))
            several, to = _split(group, around, to)
            here = pa.array(group.view(np.int64), mask=to == group)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d), pa.array(h), pa.array(unit), pa.array(to.view(np.int64)), here, pa.array(around.view(np.int64)), pa.array(known), pa.array(several)],
                ["doc", "text_hash", "unit", "to", "gram", "around", "known", "several"],
            )

    return run


def _shipped(depth: int):
    """``gid, doc, text_hash, unit, run`` of every unit in column units: the bytes of its run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text_hash = (batch.column(c).to_numpy() for c in ("doc", "text_hash"))
            units, texts = batch.column("units"), B.Texts(batch.column("text"))
            for i, j in B.chunks(texts):
                n = np.array([len(units[k]) for k in range(i, j)])
                own = units.slice(i, j - i).flatten()
                at = own.field("unit").to_numpy()
                begin, end = ((at >> 16) - (at & 255)).tolist(), ((at >> 16) + depth - (at >> 8 & 255)).tolist()
                which = np.repeat(np.arange(j - i), n)
                raw = texts[i:j]
                runs = pa.array([raw[k][a:b] for k, a, b in zip(which.tolist(), begin, end, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([own.field("gid"), pa.array(doc[i + which]), pa.array(text_hash[i + which]), own.field("unit"), runs], ["gid", "doc", "text_hash", "unit", "run"])

    return run


def _refined(group: np.ndarray, *digits: np.ndarray) -> np.ndarray:
    """The group of each row by its group and digits, in their order; -1 in a group of one."""
    order = np.lexsort((*digits[::-1], group))
    new = np.zeros(len(order), bool)
    for column in (group, *digits):
        ranked = column[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    number = np.cumsum(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.where(np.bincount(number)[number] > 1, number, -1) if len(order) else number
    return out


def repeated_windows(gid: np.ndarray, low: np.ndarray, high: np.ndarray, runs: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that are whole groups by ``gid``: run number and distance from the anchor of each window that another window equals.

    Digits of eight bytes are taken from the anchor on, to the right and to the left. A pass sorts the runs of each group
    by the next digit, which refines the group, and drops groups of one. What a window holds is so many right digits, so many
    left ones, and less than a digit on either side: windows with all of these in common are equal, byte by byte.
    """
    buf = np.frombuffer(b"".join(runs), np.uint8)
    begin = np.cumsum([0, *map(len, runs)])[:-1]
    at = begin + high
    word = B.eights(buf)

    def sides(reach: np.ndarray, digit) -> np.ndarray:
        """Row k: the group of each run by its first k digits, -1 where it is alone or does not reach as far."""
        out = [np.unique(gid, return_inverse=True)[1]]
        while True:
            group = np.full(len(at), -1, np.int64)
            active = np.flatnonzero((out[-1] >= 0) & (reach >= 8 * len(out)))
            if not len(active):
                return np.stack(out)
            group[active] = _refined(out[-1][active], word[digit(active, len(out))].byteswap())
            out.append(group)

    right = sides(depth - low, lambda rows, k: at[rows] + 8 * (k - 1))
    left = sides(high, lambda rows, k: at[rows] - 8 * k)
    size = high - low + 1
    run = np.repeat(np.arange(len(at)), size)
    a = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    i, j = a // 8, (depth - a) // 8
    ok = (i < len(left)) & (j < len(right))
    run, a, i, j = run[ok], a[ok], i[ok], j[ok]
    ok = (left[i, run] >= 0) & (right[j, run] >= 0)
    run, a, i, j = run[ok], a[ok], i[ok], j[ok]
    before = word[at[run] - a] & B.LOW[a - 8 * i]
    after = word[at[run] + 8 * j] & B.LOW[depth - a - 8 * j]
    same = _refined(left[i, run] * 256 + a, right[j, run], before, after) >= 0
    return run[same], a[same]


def _sorted_groups(depth: int):
    """``doc, text_hash, code`` of the removed stretches of each run, from rows of ``_shipped`` sorted by gid."""

    def stretches(rows: pa.Table) -> pa.RecordBatch:
        doc, text_hash, unit, gid = (rows.column(c).to_numpy() for c in ("doc", "text_hash", "unit", "gid"))
        run, a = repeated_windows(gid, unit >> 8 & 255, unit & 255, rows.column("run").to_pylist(), depth)
        new = np.concatenate(([True], (run[1:] != run[:-1]) | (a[1:] != a[:-1] + 1)))[: len(run)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(run))[: len(first)] - 1
        code = ((unit[run[first]] >> 16) - a[last]) * 1024 + depth + a[last] - a[first]
        return pa.RecordBatch.from_arrays([pa.array(doc[run[first]]), pa.array(text_hash[run[first]]), pa.array(code)], ["doc", "text_hash", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > SLAB:
                rows = pa.Table.from_batches(held).combine_chunks()
                gid = rows.column("gid").to_numpy()
                whole = int(np.searchsorted(gid, gid[-1]))
                if whole:
                    yield stretches(rows.slice(0, whole))
                    held = rows.slice(whole).to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield stretches(pa.Table.from_batches(held))

    return run


def _merged(code: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the removed runs of a text of n bytes, from stretches (start * 1024 + length)."""
    if not len(code):
        return [], []
    left = np.sort(code)
    right = np.minimum(np.maximum.accumulate((left >> 10) + (left & 1023)), n)
    left = left >> 10
    first = np.flatnonzero(np.concatenate(([True], left[1:] > right[:-1])))
    return left[first].tolist(), right[np.concatenate((first[1:] - 1, [-1]))].tolist()


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = B.Texts(batch.column("text")), batch.column("spans")
            rest = [c for c in batch.schema.names if c not in ("text", "spans")]
            for i, j in B.chunks(texts):
                out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept_text": []}
                for k, text in enumerate(texts[i:j], i):
                    a, b = _merged(spans[k].values.to_numpy() if spans[k].is_valid else np.zeros(0, np.int64), len(text))
                    kept = b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True))
                    out["n_bytes"].append(len(text))
                    out["n_removed"].append(len(text) - len(kept))
                    out["n_spans"].append(len(a))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        out["kept_text"].append(kept.decode("utf-8", "ignore") if a else text.decode("utf-8", "replace"))
                if not with_text:
                    del out["kept_text"]
                made = [pa.array(v, pa.string() if k in ("kept_sha256", "kept_text") else pa.int64()) for k, v in out.items()]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in rest] + made, [*rest, *out])

    return run


def cut_repeats(docs: DataFrame, *, depth: int = DEPTH, gram: int = GRAM, together: int = TOGETHER, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs(doc_id, text)``.

    A byte is removed if a ``depth``-byte string that covers it starts anywhere else, in the same text or another; texts
    are judged as they came, as UTF-8. Null is empty; a text shorter than ``depth`` loses nothing; with a row twice,
    each is the other's repeat. Null doc_ids are rows like others; an empty table gives an empty result; long texts are read whole, in
    pieces. With ``with_text``, kept_text holds the remaining bytes as text (characters cut in two go whole); columns named in
    ``carry`` are passed on, others are not read.

    Suffixes are sorted only as far as equality at ``depth`` bytes asks, by most-significant-digit passes that drop groups of one:

    1. The first digit deals the suffixes out: ``gram`` bytes that are chosen from a suffix by what they are, so that neighbours share
       one and travel as a run (one in some 75 bytes). A digit that no other run has ends its run. Runs that
       are equal as a whole are repeats at once, and one of them goes on, if other runs have the digit too.
    2. The runs of a digit go to one task as bytes, which sorts them by digit after digit from there on (``repeated_windows``):
       groups of two or more suffixes at full depth are the repeated windows, proved by their bytes.

    A digit with more than ``together`` runs is not sorted in one task: its runs are cut into narrower ones, whose first digit is
    all that their suffixes share, and the first pass is repeated for them, down to runs of one suffix, where the digit is the
    suffix. Whole runs are compared by two 64-bit hashes (digit and run). A row is named by doc_id and a hash of its text, so rows of one
    doc_id may differ.
    """
    if depth > 255 or not 0 < gram < depth:
        raise ValueError("depth is at most 255 bytes, and a gram shorter")
    doc_id = F.col("doc_id").cast("long")
    # The lowest bit of text_hash tells a missing doc_id from the number that stands for it.
    text_hash = F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.when(doc_id.isNull(), F.lit(1)).otherwise(0).cast("long"))
    keyed = docs.select(F.coalesce(doc_id, F.lit(_NO_ID)).alias("doc"), text_hash.alias("text_hash"), "text", *carry)

    def passed(units: DataFrame, name: str) -> DataFrame:
        """``doc, text_hash, unit, gid, again, on``: runs that are repeats as they are, and those whose digit other runs have."""
        gid = F.coalesce("gram", "to")
        ordered, whole = Window.partitionBy("to").orderBy("around", gid), Window.partitionBy("to")
        mine = F.struct("around", gid.alias("gid"))
        before, after = F.lag(mine).over(ordered), F.lead(mine).over(ordered)
        # Of equals any may come first, also one whose own batch holds no other run of the digit: what one batch has seen holds for all.
        several = F.max("several").over(whole) | (F.min("around").over(whole) != F.max("around").over(whole))
        again = F.col("known") | F.coalesce(before == mine, F.lit(False)) | F.coalesce(after == mine, F.lit(False))
        first = before.isNull() | (before != mine)
        return written(units.select("doc", "text_hash", "unit", gid.alias("gid"), again.alias("again"), (several & first).alias("on")).filter("again or on"), name)

    marks = passed(keyed.select("doc", "text_hash", "text").mapInArrow(B.lean(_first_digits(depth, gram, None)), _UNITS), "runs")
    settled, sortable, left = [marks.filter("again")], [], marks.filter("on")
    for width in NARROWER:
        common = left.groupBy("gid").count().filter(F.col("count") > together).select("gid")
        if common.isEmpty():
            break
        sortable.append(left.join(common, "gid", "left_anti"))
        units = left.join(common, "gid", "left_semi").groupBy("doc", "text_hash").agg(F.collect_list("unit").alias("units"))
        narrow = keyed.join(units, ["doc", "text_hash"]).select("doc", "text_hash", "text", "units").mapInArrow(B.lean(_first_digits(depth, gram, width)), _UNITS)
        marks = passed(narrow, f"runs-{width}")
        settled.append(marks.filter("again"))
        left = marks.filter("on")
    sortable.append(left)

    every = sortable[0].select("doc", "text_hash", "unit", "gid")
    for more in sortable[1:]:
        every = every.unionByName(more.select("doc", "text_hash", "unit", "gid"))
    units = every.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("unit", "gid")).alias("units"))
    # The joins below and above share one shuffle of the texts.
    shipped = keyed.join(units, ["doc", "text_hash"]).select("doc", "text_hash", "text", "units").mapInArrow(B.lean(_shipped(depth)), "gid long, doc long, text_hash long, unit long, run binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    codes = shipped.repartition(parts, "gid").sortWithinPartitions("gid").mapInArrow(B.lean(_sorted_groups(depth)), "doc long, text_hash long, code long")
    code = F.expr(f"(shiftright(unit, 16) - (unit & 255)) * 1024 + {depth} + (unit & 255) - (shiftright(unit, 8) & 255)")
    for again in settled:
        codes = codes.unionByName(again.select("doc", "text_hash", code.alias("code")))
    spans = codes.groupBy("doc", "text_hash").agg(F.collect_list("code").alias("spans"))
    found = keyed.join(spans, ["doc", "text_hash"], "left").select(F.when((F.col("doc") != _NO_ID) | (F.col("text_hash") % 2 == 0), F.col("doc")).alias("doc_id"), *carry, "text", "spans")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name not in ("text", "spans")]
    schema = ", ".join([*fields, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *["kept_text string"] * with_text])
    return found.mapInArrow(B.lean(_cut(with_text)), schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by counting every window, for small tables.
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * DEPTH})) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {DEPTH - 1})) AS i FROM d)),
k AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM w) WHERE c > 1),
b AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {DEPTH} THEN 1 ELSE 0 END AS new FROM k),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
r AS (SELECT doc_id, min(i) AS a, max(i) + {DEPTH} AS z FROM g GROUP BY doc_id, run),
t AS (SELECT doc_id, a, z FROM r UNION ALL SELECT doc_id, length(h) // 2, NULL FROM d),
p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a, z NULLS LAST), 0) AS y FROM t),
o AS (SELECT doc_id, sum(z - a) AS gone, count(z) AS n_spans, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a, z NULLS LAST) AS kept FROM p JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM o JOIN d USING (doc_id)"""
