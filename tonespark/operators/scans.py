"""Recurrences over ordered streams as scans: one long stream is many tasks.

A recurrence carries a state from frame to frame. What a frame does to the state is a function of a family that is closed
under composition (affine maps, min-affine maps, clamped sums, min-plus matrices ...), so blocks of frames are composed
to one function each, blocks of blocks likewise, until a stream is one block; from there states go back down, and each
block is run from the state it starts with. A task holds about PART_ROWS rows, of any mix of streams, and all its blocks
advance together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
PART_ROWS = 1 << 18


class Recurrence:
    """Functions of a family as rows of ``width`` values, states as rows of ``len(initial)`` ones."""

    initial: np.ndarray
    width: int

    def element(self, x: np.ndarray) -> np.ndarray:
        """The functions of frames with inputs ``x`` (rows x inputs)."""
        raise NotImplementedError

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def apply(self, f: np.ndarray, state: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    @property
    def kind(self) -> str:
        return "bigint" if self.initial.dtype.kind == "i" else "double"


@dataclass
class Affine(Recurrence):
    """``state = a @ state + b @ x``."""

    a: np.ndarray
    b: np.ndarray
    initial: np.ndarray

    @property
    def width(self) -> int:
        return self.a.size + len(self.a)

    def _parts(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = len(self.a)
        return f[:, : d * d].reshape(-1, d, d), f[:, d * d :]

    def element(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.broadcast_to(self.a.ravel(), (len(x), self.a.size)), x @ self.b.T], axis=1)

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        (m, c), (n, e) = self._parts(first), self._parts(then)
        return np.concatenate([(n @ m).reshape(len(m), -1), (n @ c[:, :, None])[:, :, 0] + e], axis=1)

    def apply(self, f: np.ndarray, state: np.ndarray) -> np.ndarray:
        m, c = self._parts(f)
        return (m @ state[:, :, None])[:, :, 0] + c


def smoothing(share: float, start: float = 0.0) -> Affine:
    """Exponential average: ``y += share * (x - y)``."""
    return Affine(np.array([[1 - share]]), np.array([[share]]), np.array([start]))


def iir(forward: list[float], back: list[float]) -> Affine:
    """``y[n] = sum(forward[k] * x[n - k]) - sum(back[k] * y[n - 1 - k])``; the state's first value is y, x is carried too."""
    p, q = len(back), len(forward) - 1
    a, b = np.zeros((max(1, p) + q, max(1, p) + q)), np.zeros((max(1, p) + q, 1))
    own = max(1, p)
    a[0, :p], a[0, own:] = -np.array(back, float), forward[1:]
    a[np.arange(1, own), np.arange(own - 1)] = 1
    b[0, 0] = forward[0]
    if q:
        b[own, 0] = 1
        a[np.arange(own + 1, own + q), np.arange(own, own + q - 1)] = 1
    return Affine(a, b, np.zeros(own + q))


@dataclass
class Floor(Recurrence):
    """``y = min(rise * y, x)``: falls at once, rises by a factor a frame (``rise`` over 0)."""

    rise: float
    start: float = float("inf")
    width = 2

    @property
    def initial(self) -> np.ndarray:
        return np.array([self.start])

    def element(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.full(len(x), self.rise), x[:, 0]], axis=1)

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        return np.stack([first[:, 0] * then[:, 0], np.minimum(first[:, 1] * then[:, 0], then[:, 1])], axis=1)

    def apply(self, f: np.ndarray, state: np.ndarray) -> np.ndarray:
        return np.minimum(f[:, :1] * state, f[:, 1:])


@dataclass
class Clamped(Recurrence):
    """``y = min(max(y + x, low), high)``: the clamp is carried from step to step."""

    low: int
    high: int
    start: int = 0
    width = 3

    @property
    def initial(self) -> np.ndarray:
        return np.array([self.start], np.int64)

    def element(self, x: np.ndarray) -> np.ndarray:
        return np.stack([x[:, 0], np.full(len(x), self.low), np.full(len(x), self.high)], axis=1).astype(np.int64)

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        keep = lambda v: np.minimum(np.maximum(v + then[:, 0], then[:, 1]), then[:, 2])
        return np.stack([first[:, 0] + then[:, 0], keep(first[:, 1]), keep(first[:, 2])], axis=1)

    def apply(self, f: np.ndarray, state: np.ndarray) -> np.ndarray:
        return np.minimum(np.maximum(state + f[:, :1], f[:, 1:2]), f[:, 2:])


@dataclass
class Congruential(Recurrence):
    """``y = (factor * y + x) mod 2**32`` for whole ``x`` of 32 bits."""

    factor: int
    start: int
    width = 2

    @property
    def initial(self) -> np.ndarray:
        return np.array([self.start], np.int64)

    def _low(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        u = lambda v: v.astype(np.uint64)
        return ((u(a) * u(b) + u(c)) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def element(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.full(len(x), self.factor), x[:, 0]], axis=1).astype(np.int64)

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        zero = np.zeros(len(first), np.int64)
        return np.stack([self._low(first[:, 0], then[:, 0], zero), self._low(first[:, 1], then[:, 0], then[:, 1])], axis=1)

    def apply(self, f: np.ndarray, state: np.ndarray) -> np.ndarray:
        return self._low(state[:, 0], f[:, 0], f[:, 1])[:, None]


@dataclass
class MinPlus(Recurrence):
    """Least costs of paths by state: ``v[j] = min over i of (v[i] + moves[i][j]) + x[j]``, in whole numbers."""

    moves: np.ndarray

    @property
    def width(self) -> int:
        return self.moves.size

    @property
    def initial(self) -> np.ndarray:
        return np.zeros(len(self.moves), np.int64)

    def element(self, x: np.ndarray) -> np.ndarray:
        return (self.moves[None] + x.astype(np.int64)[:, None, :]).reshape(len(x), -1)

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        s = len(self.moves)
        a, b = first.reshape(-1, s, s), then.reshape(-1, s, s)
        return np.stack([(a + b[:, None, :, j]).min(axis=2) for j in range(s)], axis=2).reshape(len(a), -1)

    def apply(self, f: np.ndarray, state: np.ndarray) -> np.ndarray:
        return (state[:, :, None] + f.reshape(len(state), *self.moves.shape)).min(axis=1)


@dataclass
class Maps(Recurrence):
    """Maps of a few states to one another, run backwards: the state a path enters a block by, from the one it leaves by."""

    states: int
    initial: np.ndarray

    @property
    def width(self) -> int:
        return self.states

    def element(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.int64)

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        return np.take_along_axis(then, first, axis=1)

    def apply(self, f: np.ndarray, state: np.ndarray) -> np.ndarray:
        return np.take_along_axis(f, state, axis=1)


class Lanes:
    """Rows of a table as blocks in order: block by block the rows' places, and how the blocks advance together."""

    def __init__(self, table: pa.Table, key: str, order: str, block: int):
        at = table[order].to_numpy()
        who = table[key].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        self.rows = np.lexsort((at, who))
        who, at = who[self.rows], at[self.rows]
        new = np.flatnonzero((np.diff(who, prepend=-2) != 0) | (np.diff(at // block, prepend=-1) != 0))
        size = np.diff(new, append=len(at))
        by_size = np.argsort(-size, kind="stable")
        self.first, self.size = new[by_size], size[by_size]
        self.blocks = at[self.first] // block

    def steps(self) -> Iterator[tuple[int, np.ndarray]]:
        """How many blocks are still live, and the places (in order) of their next rows."""
        for t in range(int(self.size.max(initial=0))):
            live = int(np.searchsorted(-self.size, -t, "left"))
            yield live, self.rows[self.first[:live] + t]

    def heads(self) -> np.ndarray:
        return self.rows[self.first]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _list(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(values).ravel()))


def _dealt(rows: DataFrame, order: str, block: int, n: int) -> DataFrame:
    """Blocks of streams dealt to parts of about PART_ROWS rows."""
    parts = max(1, n // PART_ROWS)
    return rows.withColumn("_part", F.pmod(F.xxhash64("user_id", F.floor(F.col(order) / block)), F.lit(parts)))


def _states(functions: DataFrame, r: Recurrence, block: int, n: int, most: int) -> DataFrame:
    """``user_id, at, state`` before each of ``functions`` (user_id, at, f), of which there are about ``n``, at places up to
    ``most``."""
    n, who = max(1, n), functions.schema["user_id"].dataType.simpleString()
    placed = _dealt(functions, "at", block, n)
    made = f"user_id {who}, at bigint, state array<{r.kind}>"

    def run(table: pa.Table, start: dict | None) -> pa.Table:
        lanes, f = Lanes(table, "user_id", "at", block), _matrix(table["f"], r.width)
        out = np.empty((len(f), len(r.initial)), r.initial.dtype)
        state = np.tile(r.initial, (len(lanes.first), 1))
        if start is not None:
            keys = zip(table["user_id"].take(pa.array(lanes.heads())).to_pylist(), lanes.blocks.tolist(), strict=True)
            state = np.array([start[k] for k in keys], r.initial.dtype).reshape(len(lanes.first), -1)
        for live, rows in lanes.steps():
            out[rows] = state[:live]
            state[:live] = r.apply(f[rows], state[:live])
        return pa.table({"user_id": table["user_id"], "at": table["at"], "state": _list(out)})

    if most < block:  # a stream is one block
        return placed.groupBy("_part").applyInArrow(lambda t: run(t, None), made)
    above = _states(_composed(placed, r, "at", block, lambda t: _matrix(t["f"], r.width)), r, block, n // block, most // block)
    starts = above.withColumn("_part", F.pmod(F.xxhash64("user_id", F.col("at")), F.lit(max(1, n // PART_ROWS))))
    return placed.groupBy("_part").cogroup(starts.groupBy("_part")).applyInArrow(lambda t, s: run(t, _by_block(s)), made)


def _by_block(starts: pa.Table) -> dict:
    return dict(zip(zip(starts["user_id"].to_pylist(), starts["at"].to_pylist(), strict=True), starts["state"].to_pylist(), strict=True))


def _composed(placed: DataFrame, r: Recurrence, order: str, block: int, of: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """``user_id, at, f``: the composition of each block's functions."""

    def run(table: pa.Table) -> pa.Table:
        lanes, each = Lanes(table, "user_id", order, block), of(table)
        f = each[lanes.heads()].copy()
        for t, (live, rows) in enumerate(lanes.steps()):
            if t:
                f[:live] = r.compose(f[:live], each[rows])
        return pa.table({"user_id": table["user_id"].take(pa.array(lanes.heads())), "at": pa.array(lanes.blocks), "f": _list(f)})

    return placed.groupBy("_part").applyInArrow(run, f"user_id {placed.schema['user_id'].dataType.simpleString()}, at bigint, f array<{r.kind}>")


def _inputs(table: pa.Table, columns: list[str]) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in columns], 1)


def _extent(stream: DataFrame) -> tuple[int, int]:
    n, most = stream.agg(F.count("*"), F.max("frame")).first()
    return n, most or 0


def scan(stream: DataFrame, r: Recurrence, inputs: list[str], outputs: list[str], block: int = BLOCK) -> DataFrame:
    """``user_id, frame`` and the first values of the state after each frame of ``stream`` as ``outputs``.

    ``stream`` has user_id, frame (0 and up, in any steps) and ``inputs`` that aren't null. Streams may be of any length;
    a null user_id is a stream of its own. An empty table gives no rows.
    """
    n, most = _extent(stream)
    placed = _dealt(stream.select("user_id", "frame", *inputs), "frame", block, n)
    starts = _states(_composed(placed, r, "frame", block, lambda t: r.element(_inputs(t, inputs))), r, block, n // block, most // block)
    starts = starts.withColumn("_part", F.pmod(F.xxhash64("user_id", "at"), F.lit(max(1, n // PART_ROWS))))

    def run(table: pa.Table, start: pa.Table) -> pa.Table:
        lanes, x, known = Lanes(table, "user_id", "frame", block), _inputs(table, inputs), _by_block(start)
        keys = zip(table["user_id"].take(pa.array(lanes.heads())).to_pylist(), lanes.blocks.tolist(), strict=True)
        state = np.array([known[k] for k in keys], r.initial.dtype).reshape(len(lanes.first), len(r.initial))
        out = np.empty((len(x), len(outputs)), r.initial.dtype)
        for live, rows in lanes.steps():
            state[:live] = r.apply(r.element(x[rows]), state[:live])
            out[rows] = state[:live, : len(outputs)]
        return pa.table({"user_id": table["user_id"], "frame": table["frame"], **{c: pa.array(out[:, k]) for k, c in enumerate(outputs)}})

    made = f"user_id {stream.schema['user_id'].dataType.simpleString()}, frame bigint, " + ", ".join(f"`{c}` {r.kind}" for c in outputs)
    return placed.groupBy("_part").cogroup(starts.groupBy("_part")).applyInArrow(run, made)


def _forward(x: np.ndarray, lanes: Lanes, r: MinPlus, state: np.ndarray) -> np.ndarray:
    """Back-pointers of each row: the state before, by the state reached; of equal ones the lowest."""
    back = np.empty(x.shape, np.int64)
    for live, rows in lanes.steps():
        through = state[:live, :, None] + r.moves[None]
        back[rows] = through.argmin(axis=1)
        state[:live] = through.min(axis=1) + x[rows]
    return back


def cheapest_path(stream: DataFrame, moves: list[list[int]], costs: list[str], block: int = BLOCK) -> DataFrame:
    """``user_id, frame, state``: the states of the path of least cost through each stream.

    ``moves[i][j]`` is the cost to go from state i to j (into the first frame too, from any state for nothing but that),
    ``costs`` are whole numbers by state. Of paths of equal cost the one is taken that a reader from the first frame to
    the last finds who prefers lower states: the last state is the lowest, then each one before. Forward costs are a
    min-plus scan; each block then tells by which state a path enters that leaves by a given one, and these maps are
    scanned from the last block back.
    """
    r, (n, most) = MinPlus(np.array(moves, np.int64)), _extent(stream)
    who, s = stream.schema["user_id"].dataType.simpleString(), len(moves)
    placed = _dealt(stream.select("user_id", "frame", *costs), "frame", block, n)
    parts = F.lit(max(1, n // PART_ROWS))
    starts = _states(_composed(placed, r, "frame", block, lambda t: r.element(_inputs(t, costs))), r, block, n // block, most // block)
    starts = starts.withColumn("_part", F.pmod(F.xxhash64("user_id", "at"), parts))

    def begun(table: pa.Table, start: pa.Table) -> tuple[Lanes, np.ndarray, np.ndarray, list]:
        lanes, known = Lanes(table, "user_id", "frame", block), _by_block(start)
        keys = list(zip(table["user_id"].take(pa.array(lanes.heads())).to_pylist(), lanes.blocks.tolist(), strict=True))
        state = np.array([known[k] for k in keys], np.int64).reshape(len(keys), s)
        return lanes, state, _forward(_inputs(table, costs), lanes, r, state), keys

    def maps(table: pa.Table, start: pa.Table) -> pa.Table:
        lanes, state, back, keys = begun(table, start)
        enter = np.tile(np.arange(s), (len(keys), 1))
        for live, rows in reversed(list(lanes.steps())):
            enter[:live] = np.take_along_axis(back[rows], enter[:live], axis=1)
        return pa.table({"user_id": table["user_id"].take(pa.array(lanes.heads())), "at": pa.array(lanes.blocks), "enter": _list(enter), "costs": _list(state)})

    both = placed.groupBy("_part").cogroup(starts.groupBy("_part"))
    blocks = both.applyInArrow(maps, f"user_id {who}, at bigint, enter array<bigint>, costs array<bigint>")
    last = blocks.groupBy("user_id").agg(F.max("at").alias("last"), F.max_by("costs", "at").alias("ends")).withColumnRenamed("user_id", "who")
    # From the last block back: the state that a block is left by is where the one after it is entered.
    turned = blocks.join(last, F.col("user_id").eqNullSafe(F.col("who"))).select("user_id", (F.col("last") - F.col("at")).alias("at"), F.col("enter").alias("f"), "last", "ends")
    best = F.array_position("ends", F.array_min("ends")) - 1
    # The last block's own start is the best end: a constant map before it.
    whole = turned.select("user_id", (F.col("at") + 1).alias("at"), "f").unionByName(turned.where("at = 0").select("user_id", "at", F.array_repeat(best, s).alias("f")))
    left = _states(whole.repartition("user_id", "at"), Maps(s, np.arange(s)), block, n // block, most // block + 1)
    ends = left.where("at > 0").join(last.select("who", "last"), F.col("user_id").eqNullSafe(F.col("who")))
    ends = ends.select("user_id", (F.col("last") + 1 - F.col("at")).alias("at"), F.get("state", F.lit(0)).alias("leave"))
    told = starts.join(ends.select(F.col("user_id").alias("who"), F.col("at").alias("of"), "leave"), F.col("user_id").eqNullSafe(F.col("who")) & (F.col("at") == F.col("of")))

    def trace(table: pa.Table, start: pa.Table) -> pa.Table:
        lanes, _, back, keys = begun(table, start)
        leave = dict(zip(zip(start["user_id"].to_pylist(), start["at"].to_pylist(), strict=True), start["leave"].to_pylist(), strict=True))
        now, out = np.array([leave[k] for k in keys], np.int64), np.empty(len(back), np.int64)
        for live, rows in reversed(list(lanes.steps())):
            out[rows] = now[:live]
            now[:live] = back[rows, now[:live]]
        return pa.table({"user_id": table["user_id"], "frame": table["frame"], "state": pa.array(out)})

    told = told.select("user_id", "at", "state", "leave", "_part")
    return placed.groupBy("_part").cogroup(told.groupBy("_part")).applyInArrow(trace, f"user_id {who}, frame bigint, state bigint")
