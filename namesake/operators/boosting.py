"""Boosted trees of depth 2 over distinct rows of binned features; all rounds run in one stage, whose tasks add up their sums over sockets."""

from __future__ import annotations

import hmac
import pickle
import secrets
import socket
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession

#: Bits of a bin in a key, whose lowest bit is the label; distinct rows of a task; rows that are worked on at once; cells of features that are summed together.
BITS, TASK_ROWS, SLAB, CELLS = 5, 250_000, 1 << 16, 1024
#: Seconds that a task waits for another.
WAIT = 600

#: A value, or (feature, cut, below, above): bins up to ``cut`` go below.
Tree = float | tuple[int, float, "Tree", "Tree"]


def packed(label: np.ndarray, bins: list[np.ndarray]) -> np.ndarray:
    """A key of 64 bits for each row: its label and the bins of up to twelve features."""
    key = label.astype(np.int64)
    for f, b in enumerate(bins):
        key |= b.astype(np.int64) << (1 + BITS * f)
    return key


def _sets(sizes: list[int]) -> list[list[int]]:
    """Features in sets with no more than CELLS combinations of bins each."""
    sets: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        room = next((s for s in sets if np.prod([sizes[g] for g in s]) * sizes[f] <= CELLS), None)
        if room is None:
            sets.append([f])
        else:
            room.append(f)
    return sets


def _split(weights: list[np.ndarray], sums: list[np.ndarray], used: list[np.ndarray]) -> tuple[float, tuple[int, float] | None]:
    """The mean of a node, and the feature and cut that lessen its variance most, the first of equals; ``used``: the bins that occur at all."""
    weight, total = weights[0].sum(), sums[0].sum()
    best, found = 0.0, None
    for f, (w, s, bins) in enumerate(zip(weights, sums, used, strict=True)):
        w, s = np.cumsum(w[bins])[:-1], np.cumsum(s[bins])[:-1]
        both = (w > 0) & (w < weight)
        if not both.any():
            continue
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = np.where(both, s**2 / w + (total - s) ** 2 / (weight - w) - total**2 / weight, -np.inf)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = gain[k], (f, (bins[k] + bins[k + 1]) / 2)
    return (total / weight if weight else 0.0), found


def grown(key: np.ndarray, weight: np.ndarray, sizes: list[int], rounds: int, step: float, meet: Callable[[np.ndarray], np.ndarray]) -> list[Tree]:
    """The trees of the logistic loss; ``meet`` adds up an array over all tasks, each of which comes to the same trees.

    The first tree fits labels of -1 and 1 and counts whole, the others fit the gradient and count ``step``, as in Spark's boosting.
    """
    n, features = len(key), range(len(sizes))
    bins = [((key >> (1 + BITS * f)) & (1 << BITS) - 1).astype(np.uint8) for f in features]
    sets = _sets(sizes)
    shapes = [tuple(sizes[f] for f in s) for s in sets]
    codes = [np.ravel_multi_index([bins[f] for f in s], shape).astype(np.uint16) for s, shape in zip(sets, shapes, strict=True)]
    at = {f: (k, i) for k, s in enumerate(sets) for i, f in enumerate(s)}
    y, weight, margin, rest = (key & 1) * 2.0 - 1, weight.astype(float), np.zeros(n), np.zeros(n)
    slabs = [slice(x, min(x + SLAB, n)) for x in range(0, n, SLAB)]

    pairs = list(combinations(features, 2))
    joint = [np.bincount(bins[a].astype(np.int64) * sizes[b] + bins[b], weight, sizes[a] * sizes[b]) for a, b in pairs]
    own = [np.bincount(bins[f], weight, sizes[f]) for f in features]
    del bins
    every = np.split(meet(np.concatenate(own + joint)), np.cumsum([len(x) for x in own + joint])[:-1])
    own = every[: len(own)]
    joint = {f: np.diag(own[f]) for f in features} | {k: x.reshape(sizes[k[0]], sizes[k[1]]) for k, x in zip(pairs, every[len(own) :], strict=True)}
    met = lambda a, b: joint[a] if a == b else joint[a, b] if a < b else joint[b, a].T
    used = [np.flatnonzero(x) for x in own]
    if not own or not own[0].sum():
        return []

    def table(f: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of the set of a feature, and ``values``, one for each of its bins, by code."""
        k, i = at[f]
        return codes[k], np.broadcast_to(values.reshape([-1 if j == i else 1 for j in range(len(shapes[k]))]), shapes[k]).ravel()

    def by_feature(sums: list[np.ndarray]) -> list[np.ndarray]:
        parts = np.split(meet(np.concatenate(sums)), np.cumsum([len(x) for x in sums])[:-1])
        return [parts[k].reshape(shapes[k]).sum(axis=tuple(j for j in range(len(shapes[k])) if j != i)) for k, i in (at[f] for f in features)]

    def leaf(node: Tree) -> tuple[int, np.ndarray]:
        """A feature, and the value of a tree of one split at each of its bins."""
        if not isinstance(node, tuple):
            return 0, np.full(sizes[0], node)
        return node[0], np.where(np.arange(sizes[node[0]]) <= node[1], node[2], node[3])

    trees: list[Tree] = []
    lift: tuple | None = None
    for t in range(rounds):
        sums = [np.zeros(int(np.prod(shape))) for shape in shapes]
        for x in slabs:
            if lift is not None:
                (c0, left), (cl, low), (cr, high) = lift
                margin[x] += np.where(left[c0[x]], low[cl[x]], high[cr[x]])
            with np.errstate(over="ignore"):
                rest[x] = weight[x] * (y[x] if t == 0 else 4 * y[x] / (1 + np.exp(2 * y[x] * margin[x])))
            for code, s in zip(codes, sums, strict=True):
                s += np.bincount(code[x], rest[x], len(s))
        whole = by_feature(sums)
        mean, found = _split(own, whole, used)
        scale = 1.0 if t == 0 else step
        tree: Tree = mean
        ones = np.full(sizes[0], True)
        low = high = (0, np.full(sizes[0], mean))
        if found is not None:
            f, cut = found
            below = np.arange(sizes[f]) <= cut
            code_f, side = table(f, below)
            sums = [np.zeros(int(np.prod(shape))) for shape in shapes]
            for x in slabs:
                part = rest[x] * side[code_f[x]]
                for code, s in zip(codes, sums, strict=True):
                    s += np.bincount(code[x], part, len(s))
            mine = by_feature(sums)
            children = []
            for place, ys in ((below, mine), (~below, [a - b for a, b in zip(whole, mine, strict=True)])):
                ws = [met(f, g)[place].sum(axis=0) for g in features]
                value, child = _split(ws, [np.where(w > 0, s, 0.0) for w, s in zip(ws, ys, strict=True)], used)
                if child is not None:
                    g, c = child
                    half = np.arange(sizes[g]) <= c
                    value = (g, c, *(float(s[h].sum() / w[h].sum()) for h in (half, ~half) for s, w in ((np.where(ws[g] > 0, ys[g], 0.0), ws[g]),)))
                children.append(value)
            tree, ones = (f, cut, *children), below
            low, high = (leaf(c) for c in children)
        trees.append(tree)
        lift = table(0 if found is None else found[0], ones), table(low[0], low[1] * scale), table(high[0], high[1] * scale)
    return trees


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once, as the scheduler counts them for a stage whose tasks meet."""
    context = spark.sparkContext._jsc.sc()
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


def _read(peer: socket.socket, size: int) -> bytes:
    data = bytearray()
    while len(data) < size:
        some = peer.recv(min(size - len(data), 1 << 20))
        if not some:
            raise ConnectionError("a task of this stage has ended early")
        data += some
    return bytes(data)


@contextmanager
def _meeting(context: BarrierTaskContext) -> Iterator[Callable[[np.ndarray], np.ndarray]]:
    """A ``meet`` for the tasks of a barrier stage: the first one adds up what the others send it.

    They learn its port and a secret by ``allGather``, once: that takes a second each time, as its waiting side looks up once a second.
    """
    me, hosts = context.partitionId(), [i.address.rsplit(":", 1)[0] for i in context.getTaskInfos()]
    with ExitStack() as held:
        peers: list[socket.socket] = []
        if len(hosts) > 1:
            if me == 0:
                server = held.enter_context(socket.create_server(("", 0), backlog=len(hosts)))
                server.settimeout(WAIT)
                secret = secrets.token_bytes(16)
                context.allGather(f"{server.getsockname()[1]} {secret.hex()}")
                by: dict[int, socket.socket] = {}
                while len(by) < len(hosts) - 1:
                    peer = held.enter_context(server.accept()[0])
                    peer.settimeout(WAIT)
                    if hmac.compare_digest(_read(peer, 16), secret):
                        by[int.from_bytes(_read(peer, 4), "big")] = peer
                peers = [by[k] for k in sorted(by)]
            else:
                port, secret = context.allGather("")[0].split()
                peers = [held.enter_context(socket.create_connection((hosts[0], int(port)), WAIT))]
                peers[0].sendall(bytes.fromhex(secret) + me.to_bytes(4, "big"))
            for peer in peers:
                peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

        def meet(sums: np.ndarray) -> np.ndarray:
            if me and peers:
                peers[0].sendall(sums.tobytes())
                return np.frombuffer(_read(peers[0], sums.nbytes))
            for peer in peers:
                sums = sums + np.frombuffer(_read(peer, sums.nbytes))
            for peer in peers:
                peer.sendall(sums.tobytes())
            return sums

        yield meet


def grow(rows: DataFrame, sizes: list[int], rounds: int, step: float) -> list[Tree]:
    """``grown`` over ``rows(key, weight)`` of all tasks of a barrier stage; the rows are counted first, so give them kept."""
    tasks = max(1, min(slots(rows.sparkSession), -(-rows.count() // TASK_ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("key").to_numpy(), b.column("weight").to_numpy()) for b in batches if b.num_rows]
        key, weight = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in range(2))
        held.clear()
        context = BarrierTaskContext.get()
        with _meeting(context) as meet:
            trees = grown(key, weight, sizes, rounds, step, meet)
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_pydict({"trees": [pickle.dumps(trees)]})

    made = rows.select("key", "weight").repartition(tasks).mapInArrow(run, "trees binary", barrier=True)
    return pickle.loads(made.collect()[0][0])  # of all partitions: a barrier stage can't run some of them


def margins(trees: list[Tree], sizes: list[int], step: float) -> tuple[float, dict[tuple[int, int], np.ndarray]]:
    """The trees as a constant and, by two features (or one twice), a table over their bins: a leaf asks for no more features."""
    constant, tables = 0.0, {}

    def add(a: int, b: int, values: np.ndarray) -> None:
        if a > b:
            a, b, values = b, a, values.T
        held = tables.setdefault((a, b), np.zeros((sizes[a], sizes[b])))
        held += np.diag(np.diag(values)) if a == b else values

    for t, tree in enumerate(trees):
        scale = step if t else 1.0
        if not isinstance(tree, tuple):
            constant += scale * tree
            continue
        f, cut, *children = tree
        below = np.arange(sizes[f]) <= cut
        for side, child in zip((below, ~below), children, strict=True):
            g, values = f, np.full(sizes[f], child) if not isinstance(child, tuple) else None
            if values is None:
                g, c, low, high = child
                values = np.where(np.arange(sizes[g]) <= c, low, high)
            add(f, g, scale * side[:, None] * values[None, :])
    return constant, tables


def margin_of(made: tuple[float, dict[tuple[int, int], np.ndarray]], bins: list[np.ndarray]) -> np.ndarray:
    """The sum of all trees for rows of bins."""
    constant, tables = made
    out = np.full(len(bins[0]), constant)
    wide = [b.astype(np.int32) for b in bins]
    for (a, b), values in tables.items():
        out += values.ravel()[wide[a] * values.shape[1] + wide[b]]
    return out
