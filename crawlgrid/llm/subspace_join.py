"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine of at least c have a squared distance of at most
2 - 2c. The vectors are turned by a fixed random rotation and their dimensions
are split into blocks; each block gets a share of the squared-distance budget
in proportion to its dimensions. If a pair is within the whole budget, it is
within the share of at least one block. So each block is range-joined by
itself, and the union of the candidates is verified exactly, by the cosine of
the given vectors in double precision.

A block's join is a band join over tiles of about ``TILE`` vectors that lie
together (k-d cells with boundaries from a sample, so that a dense region has
more tiles, not larger ones). Each vector is stored once, in a file of its
tile, and the tasks read the pairs of tiles that the bands of a block reach;
within a pair of tiles, the strips of rows that a band reaches are compared in
numpy. So disk grows with the vectors, whatever the number of pairs. Links are
counted there, and only spanning links leave the task.

Equal vectors are merged first and stand for each other. Null and zero
vectors, such as hold null or non-finite components, and rows with a null id
link with nothing (a null id has no component). Vectors of different lengths
don't link. Repeated rows count as vectors of their own. Files are written
through Arrow file systems to ``spark.checkpoint.dir``; a retried task writes
new names, and only those in the committed list are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlgrid.session import scratch_dir

from .chosen_path import grouped
from .components import components, local_roots, saved
from .warc import file_system

COSINE = 0.9
BLOCKS = 4
TILE = 6000
STRIP = 512
SLACK = 1e-9  # of rounding, in distances of unit vectors
ROUGH = 1e-4  # of rounding in single precision
TILE_NUMBERS = 4 << 20  # in a tile at most, however long its vectors are
SAMPLE_NUMBERS = 4 << 20  # for the boundaries of the tiles
LEAST_SAMPLE = 16  # of a cell
VERIFY_NUMBERS = 1 << 20
HELD_TILES = 8  # at most, against which a task compares each tile that it reads
TASKS = 300  # from which on a task holds more than one


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for all vectors of this length."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def split(dim: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dim), min(BLOCKS, dim))


def budgets(dim: int, cosine: float) -> list[float]:
    return [(2 - 2 * cosine) * len(b) / dim + SLACK for b in split(dim)]


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of one length."""
    return np.asarray(col.flatten()).reshape(len(col), -1)


def turned(raw: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rotated unit vectors, and which of them can be compared: squares of
    very small or large components leave the range of doubles."""
    with np.errstate(all="ignore"):
        points = unit(raw.astype(np.float64)) @ turn
    fine = np.isfinite(points).all(1)
    return np.where(fine[:, None], points, 0).astype(np.float32), fine


# -- tiles ------------------------------------------------------------------
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def cells(points: np.ndarray, leaves: int) -> Tree:
    """A k-d tree over a sample, (axis, cut, lower, upper) for each node; cells
    are complements of their numbers."""
    nodes: list[list] = []
    found = 0

    def grow(rows: np.ndarray, leaves: int) -> int:
        nonlocal found
        if leaves > 1 and len(rows) >= 2 * LEAST_SAMPLE:
            axis = int(points[rows].var(0).argmax())
            at = points[rows, axis]
            cut = np.partition(at, k := len(rows) * (leaves // 2) // leaves)[k]
            if (below := at < cut).any():
                nodes.append(node := [axis, cut, 0, 0])
                number = len(nodes) - 1
                node[2] = grow(rows[below], leaves // 2)
                node[3] = grow(rows[~below], leaves - leaves // 2)
                return number
        found += 1
        return -found

    grow(np.arange(len(points)), leaves)
    cols = list(zip(*nodes)) or [(), (), (), ()]
    return tuple(np.array(c, t) for c, t in zip(cols, (np.int32, np.float32, np.int32, np.int32)))


def locate(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The cell of each point."""
    axis, cut, lower, upper = tree
    at = np.full(len(points), 0 if len(axis) else -1, np.int32)
    while len(on := np.flatnonzero(at >= 0)):
        node = at[on]
        at[on] = np.where(points[on, axis[node]] < cut[node], lower[node], upper[node])
    return ~at


def in_strips(points: np.ndarray) -> np.ndarray:
    """An order in which each ``STRIP`` rows lie together."""
    out = []

    def cut(rows: np.ndarray) -> None:
        if len(rows) <= STRIP:
            out.append(rows)
            return
        k = STRIP * (-(-len(rows) // STRIP) // 2)
        part = np.argpartition(points[rows, points[rows].var(0).argmax()], k)
        cut(rows[part[:k]])
        cut(rows[part[k:]])

    cut(np.arange(len(points)))
    return np.concatenate(out)


def merged(k1: np.ndarray, k2: np.ndarray, rep: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of each class of equal keys, least rep, copies)."""
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return order[first], np.minimum.reduceat(rep[order], first), np.add.reduceat(copies[order], first)


def tile_rows(dim: int) -> int:
    return max(1, min(TILE, TILE_NUMBERS // dim) // STRIP) * STRIP


def placed(sound: DataFrame, element: str) -> DataFrame:
    """(dim, cell, k1, k2, rep, copies, vec); equal vectors of a batch are merged."""
    counts = {r.dim: r.n for r in sound.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row for each length
    several = {dim: -(-n // tile_rows(dim)) for dim, n in counts.items() if n > tile_rows(dim)}
    trees: dict[int, Tree] = {}
    if several:
        # a sample for boundaries alone: of least hash, so that copies don't count
        share = max(1, sum(counts[dim] * dim for dim in several) // SAMPLE_NUMBERS)
        some = sound.where(F.pmod("k2", F.lit(share)) == 0).dropDuplicates(["k1", "k2"]).select("vec").toArrow().column("vec").combine_chunks()
        dims = np.diff(np.asarray(some.offsets))
        for dim, tiles in several.items():
            sample = some.take(pa.array(np.flatnonzero(dims == dim)))
            trees[dim] = cells(turned(matrix(sample), rotation(dim))[0], tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, ids = (np.asarray(c) for c in batch.columns[:3])
            rows, rep, copies = merged(k1, k2, ids, np.ones(len(ids), np.int64))
            vec = batch.column(3).take(pa.array(rows))
            dims = np.diff(np.asarray(vec.offsets))
            cell = np.zeros(len(rows), np.int32)
            for dim in set(np.unique(dims).tolist()) & set(trees):
                at = np.flatnonzero(dims == dim)
                turn = turns[dim] if dim in turns else turns.setdefault(dim, rotation(dim))
                cell[at] = locate(trees[dim], turned(matrix(vec.take(pa.array(at))), turn)[0])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (dims.astype(np.int32), cell, k1[rows], k2[rows], rep, copies)] + [vec],
                                             names=["dim", "cell", "k1", "k2", "rep", "copies", "vec"])

    return sound.select("k1", "k2", "vec_id", "vec").mapInArrow(run, f"dim int, cell int, k1 long, k2 long, rep long, copies long, vec array<{element}>")


STORED = "k1 long, k2 long, node long, rep long, copies long, path string, dim int, rows int, low binary, high binary"
STORED_ARROW = pa.schema([*((c, pa.int64()) for c in ("k1", "k2", "node", "rep", "copies")), ("path", pa.string()), ("dim", pa.int32()),
                          ("rows", pa.int32()), ("low", pa.binary()), ("high", pa.binary())])


def stored(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the tiles; a row (k1, k2, node, rep, copies) for each class and
    one (path, dim, rows, and its box in low and high) for each tile."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def table(n: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in STORED_ARROW], schema=STORED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        root = root.rstrip("/")
        node = TaskContext.get().partitionId() << 32  # counts on from here
        turns: dict[int, np.ndarray] = {}
        for (dim, _), cols in grouped(batches, 2):
            dim = int(dim)
            turn = turns[dim] if dim in turns else turns.setdefault(dim, rotation(dim))
            k1, k2, rep, copies = (np.asarray(c) for c in cols[:4])
            rows, rep, copies = merged(k1, k2, rep, copies)
            k1, k2 = k1[rows], k2[rows]
            raw = matrix(cols[4].take(pa.array(rows)))
            points = turned(raw, turn)[0]
            order = in_strips(points)
            nodes = np.arange(node, node := node + len(order))
            yield table(len(order), k1=k1[order], k2=k2[order], node=nodes, rep=rep[order], copies=copies[order])
            store.create_dir(root, recursive=True)
            for s in range(0, len(order), step := tile_rows(dim)):
                some = order[s:s + step]
                name = f"tile-{uuid.uuid4().hex}"
                with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for x in (nodes[s:s + step], copies[some], raw[some]):
                        out.write(np.ascontiguousarray(x).tobytes())
                box = points[some]
                yield table(1, path=[name], dim=[dim], rows=[len(some)], low=[box.min(0).tobytes()], high=[box.max(0).tobytes()])

    keys = ("dim", "cell")
    path = f"{folder}/list"
    rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, STORED).write.parquet(path)
    return spark.read.schema(STORED).parquet(path)


class Tile:
    """The vectors of a file, with what is compared of its strips."""

    def __init__(self, store, path: str, dim: int, rows: int, kind: type, turn: np.ndarray):
        with store.open_input_stream(path, compression=None) as f:
            data = f.read()
        self.nodes, self.copies = np.frombuffer(data, np.int64, 2 * rows).reshape(2, rows)
        self.raw = np.frombuffer(data, kind, rows * dim, 16 * rows).reshape(rows, dim)
        self.points, self.fine = turned(self.raw, turn)
        self.starts = np.arange(0, rows, STRIP)
        self.low, self.high = np.minimum.reduceat(self.points, self.starts), np.maximum.reduceat(self.points, self.starts)
        self.sides: dict[tuple[int, int], tuple[list[np.ndarray], list[np.ndarray]]] = {}

    def side(self, start: int, end: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Each strip's dimensions from start to end, as left and as right
        factors whose product is squared distances."""
        if (start, end) not in self.sides:
            x = self.points[:, start:end]
            norm = np.where(self.fine, np.einsum("ij,ij->i", x, x), np.inf).astype(np.float32)[:, None]
            left, right = np.concatenate((-2 * x, norm, np.ones_like(norm)), 1), np.concatenate((x, np.ones_like(norm), norm), 1)
            self.sides[start, end] = [left[s:s + STRIP] for s in self.starts], [np.ascontiguousarray(right[s:s + STRIP].T) for s in self.starts]
        return self.sides[start, end]


def reached(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """For each block, the boxes that one box's band reaches."""
    gap = np.maximum(np.maximum(lows - high, low - highs), 0) ** 2
    gap = np.add.reduceat(gap, [b[0] for b in split(len(low))], axis=1)
    return ((gap <= limits) & (gap.sum(1) <= limits.sum())[:, None]).T


RESULT = "u long, v long, links long"


def near(a: Tile, b: Tile, k: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of strip k of a and the rows of b, a superset of the pairs with that
    cosine. Where the bands of several blocks reach a strip, the first half of
    the blocks is compared at once, against the whole budget: that misses no
    pair either and is less work than one block after the other."""
    blocks, dim = split(a.raw.shape[1]), a.raw.shape[1]
    limits = np.array(budgets(dim, cosine), np.float32) + np.float32(ROUGH)
    half = blocks[len(blocks) // 2 - 1][-1] + 1
    reach = reached(a.low[k], a.high[k], b.low, b.high, limits)
    if a is b:
        reach[:, :k] = False
    xs, ys, held = [], [], np.empty((STRIP, STRIP), np.float32)
    for t in np.flatnonzero(reach.any(0)).tolist():
        if reach[:, t].sum() > 1:
            start, end, limit = 0, half, limits.sum()
        else:
            block = int(reach[:, t].argmax())
            start, end, limit = blocks[block][0], blocks[block][-1] + 1, limits[block]
        left, right = a.side(start, end)[0][k], b.side(start, end)[1][t]
        gap = np.matmul(left, right, out=held[:len(left), :right.shape[1]])
        if gap.min() <= limit:
            some = np.flatnonzero(gap.min(1) <= limit)
            x, y = np.nonzero(gap[some] <= limit)
            xs.append(some[x] + k * STRIP)
            ys.append(y + t * STRIP)
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
    return (x[x < y], y[x < y]) if a is b else (x, y)


def compare(a: Tile, b: Tile, cosine: float) -> pa.RecordBatch | None:
    """Of two tiles, or a tile and itself: (node, null, links) and spanning links (u, v, null)."""
    shift = 0 if a is b else len(a.nodes)
    ids = a.nodes if a is b else np.concatenate((a.nodes, b.nodes))
    copies = a.copies if a is b else np.concatenate((a.copies, b.copies))
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for k in range(len(a.starts)):
        left, right = near(a, b, k, cosine)
        for s in range(0, len(left), step := max(1, VERIFY_NUMBERS // a.raw.shape[1])):
            x, y = left[s:s + step], right[s:s + step]
            u, v = a.raw[x].astype(np.float64), b.raw[y].astype(np.float64)
            with np.errstate(all="ignore"):
                size = np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v))
                on = np.einsum("ij,ij->i", u, v) / size >= cosine
            x, y = x[on], y[on] + shift
            if len(x):
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                root = local_roots(len(ids), np.concatenate((np.arange(len(ids)), x)), np.concatenate((root, y)))
    some = np.flatnonzero(links)
    if not len(some):
        return None
    far = np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids[some], ids[far]))), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[root[far]])]),
                                       pa.concat_arrays([pa.array(links[some]), pa.nulls(len(far), pa.int64())])], names=["u", "v", "links"])


def partners(i: int, n: int) -> np.ndarray:
    """The tiles that tile i of n meets: itself and half of the others, so that each pair meets once."""
    on = (np.arange(n) - i) % n
    return (on * 2 < n) | ((on * 2 == n) & (np.arange(n) > i))


def linked(tiles: DataFrame, folder: str, kind: type, cosine: float) -> DataFrame:
    """``RESULT`` over all pairs of tiles that a band reaches."""
    spark = tiles.sparkSession
    listed = tiles.select("dim", "rows", "path", "low", "high").orderBy("dim", "path").collect()  # a row for each tile
    groups = {}
    for dim in sorted({r.dim for r in listed}):
        own = [r for r in listed if r.dim == dim]
        groups[dim] = ([(r.path, r.rows) for r in own], *(np.frombuffer(b"".join(r[c] for r in own), np.float32).reshape(-1, dim) for c in ("low", "high")))
    work = []
    for dim, (own, _, _) in groups.items():
        held = min(HELD_TILES, max(1, len(own) // TASKS))
        work += [(dim, s, min(s + held, len(own))) for s in range(0, len(own), held)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        for dim, start, end in (work[w] for batch in batches for w in batch.column(0).to_pylist()):
            own, lows, highs = groups[dim]
            turn, limits = rotation(dim), np.array(budgets(dim, cosine), np.float32) + np.float32(ROUGH)
            load = lambda i: Tile(store, f"{root.rstrip('/')}/{own[i][0]}", dim, own[i][1], kind, turn)
            held = {i: load(i) for i in range(start, end)}
            meets = {i: partners(i, len(own)) & reached(lows[i], highs[i], lows, highs, limits).any(0) for i in held}
            for j in np.flatnonzero(np.any(list(meets.values()), axis=0)).tolist():
                other = held[j] if j in held else load(j)
                for i, tile in held.items():
                    if meets[i][j] and (got := compare(tile, other, cosine)):
                        yield got

    return spark.range(0, len(work), 1, max(1, min(len(work), 4 * TASKS))).mapInArrow(run, RESULT)


def join(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id) for each row."""
    spark = vectors.sparkSession
    given = vectors.schema[vec_col].dataType
    element, kind = ("float", np.float32) if isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType) else ("double", np.float64)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{element}>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", F.when(sound, F.col("vec")).alias("vec"))
    rows = rows.select("vec_id", "vec", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(1), "vec").alias("k2"))
    sound_rows = rows.where("vec is not null")
    folder = scratch_dir(spark, "tiles")
    # a repeated id with several vectors: one point for each vector, told apart by their keys
    kept = stored(placed(sound_rows, element), folder)
    classes = kept.where("path is null").select("node", "k1", "k2", "rep", "copies")
    exact = saved(linked(kept.where("path is not null"), folder, kind, cosine))
    links = exact.where("links is not null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(exact.where("links is null").select("u", "v"))
    known = (classes.join(links, "node", "left").join(roots, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    least = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = known.join(least, "root").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    has = sound_rows.select("vec_id", "k1", "k2").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    lone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return has.unionByName(lone)
