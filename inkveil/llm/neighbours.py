"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors are scaled and given one more coordinate so that the largest inner product is the smallest distance. This is done
by bands of norms, a factor of two each, so that no long vector makes all others look alike. A Gaussian (2-stable) matrix
takes them to a few dimensions, where the squared distance of two points is their true one times a chi-square variable.

The projected space of a band is cut into cells by the planes of a kd-tree that is fitted on a bounded sample; every
vector lies in one cell. A query visits the cells in the order of the product that their boxes promise, in rounds: after
each round, cells (and within a cell the leaves of its own kd-tree) are left out when they are so far away that a vector
nearer than the k-th found would lie beyond them only with a small probability. So a vector goes to one task in a round,
however many queries there are, and a query goes to the cells that its test leaves.

Copies of one vector are one candidate with several ids, of which only the least can be in a result: when they are more
than one in MOST_HOT of all rows they are cut down to those before anything is placed. Equal queries are searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.storage import MOST_HOT, join_classes, materialize

PROJECTED = 8
CONFIDENCE = 0.5
LEAF_ROWS = 512
CELL_ROWS = 16384  # wanted in a cell; a fuller one is dealt over blocks of that many
MOST_CELLS = 8192  # of all bands; a larger table has fuller cells
SAMPLE_PER_CELL = 32  # projected points that the planes are fitted on
VISITS = 65536  # queries that one copy of a block serves
ROUNDS = (1, 8, MOST_CELLS)  # cells that a query has seen after each round, at most
QUERY_ROWS = 1024
SPARE = 8
SEED = 11


def chi_square_quantile(p: float, degrees: int) -> float:
    """The value that a chi-square variable of an even number of degrees stays below with probability ``p``."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for j in range(1, degrees // 2):
            term *= x / 2 / j
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def box_distances(points: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(least)))
    for k in range(points.shape[1]):
        q = points[:, k : k + 1]
        out += np.maximum(0, np.maximum(least[:, k] - q, q - most[:, k])) ** 2
    return out


class KdTree:
    """Leaves of a kd-tree (median splits of the widest dimension) as ranges of ``order``, with their boxes."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        bounds, stack = [], [(0, len(points))]
        while stack:
            lo, hi = stack.pop()
            if hi - lo <= leaf_rows:
                bounds.append((lo, hi))
                continue
            own = self.order[lo:hi]
            part = points[own]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            mid = (hi - lo) // 2
            self.order[lo:hi] = own[np.argpartition(part[:, axis], mid)]
            stack += [(lo + mid, hi), (lo, lo + mid)]
        self.lo, self.hi = (np.array(x) for x in zip(*bounds, strict=True))
        placed = points[self.order]
        self.least = np.minimum.reduceat(placed, self.lo, axis=0)
        self.most = np.maximum.reduceat(placed, self.lo, axis=0)


class Planes:
    """The splits of a kd-tree fitted on sample points, which send any point to one of its cells."""

    def __init__(self, points: np.ndarray, cells: int):
        self.axis, self.value, self.child, self.cell, self.cells = [], [], [], [], 0
        self._split(points, cells)
        self.axis, self.value, self.child, self.cell = (np.array(x) for x in (self.axis, self.value, self.child, self.cell))

    def _split(self, points: np.ndarray, cells: int) -> int:
        me = len(self.axis)
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
        if cells < 2 or not spread.max():
            self.axis.append(0), self.value.append(0.0), self.child.append((me, me)), self.cell.append(self.cells)
            self.cells += 1
            return me
        axis, left = int(np.argmax(spread)), cells // 2
        value = float(np.quantile(points[:, axis], left / cells))
        below = points[:, axis] < value
        self.axis.append(axis), self.value.append(value), self.child.append((me, me)), self.cell.append(-1)
        self.child[me] = (self._split(points[below], left), self._split(points[~below], cells - left))
        return me

    def place(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), int)
        while len(at) and (self.cell[at] < 0).any():
            at = self.child[at, (points[np.arange(len(points)), self.axis[at]] >= self.value[at]).astype(int)]
        return self.cell[at]


def _matrix(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size + 1, PROJECTED))


def project_vectors(vectors: np.ndarray, longest: np.ndarray | float) -> np.ndarray:
    """Projections of vectors that are scaled by the longest of their band and lifted onto the unit sphere."""
    scaled = vectors / np.reshape(longest, (-1, 1))
    lifted = np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))])
    return lifted @ _matrix(vectors.shape[1])


def project_queries(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Projections of the queries' directions, each the same whatever stands beside it, and the queries' lengths."""
    peak = np.abs(queries).max(axis=1, keepdims=True)
    lengths = peak[:, 0] * np.sqrt(((queries / peak) ** 2).sum(axis=1))
    matrix, unit = _matrix(queries.shape[1])[:-1], queries / lengths[:, None]
    return np.column_stack([(unit * matrix[:, k]).sum(axis=1) for k in range(PROJECTED)]), lengths


def gaps(bound: np.ndarray, lengths: np.ndarray, longest: np.ndarray | float) -> np.ndarray:
    """Squared distance, on the sphere of a band, of a vector whose product with the query is ``bound``."""
    return np.maximum(0, 2 - 2 * (bound / lengths) / longest)


class Block:
    """Vectors of a cell with their own kd-tree; equal vectors are one."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, k: int):
        vectors = np.ascontiguousarray(vectors)
        _, first, which = np.unique(vectors.view(np.dtype((np.void, vectors.strides[0]))).ravel(), return_index=True, return_inverse=True)
        vectors = vectors[first]
        self.k, self.longest, self.tree = k, longest, KdTree(project_vectors(vectors, longest))
        self.vectors = vectors[self.tree.order]
        place = np.empty(len(first), int)
        place[self.tree.order] = np.arange(len(first))
        pairs = np.unique(np.column_stack([place[which], ids]), axis=0)  # by vector, then by id
        begin = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        few = np.arange(len(pairs)) - begin[pairs[:, 0]] < k + 2
        self.ids, self.begin = pairs[few, 1], np.searchsorted(pairs[few, 0], np.arange(len(first) + 1))

    @np.errstate(over="ignore", invalid="ignore")
    def search(self, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, product) of about the k + 1 nearest of each query whose product is no less than ``bound``;
        ids equal to ``own`` are left out."""
        points, lengths = project_queries(queries)
        far, limit = box_distances(points, self.tree.least, self.tree.most), chi_square_quantile(confidence, PROJECTED)
        order, wanted, every = np.argsort(far, axis=1, kind="stable"), self.k + 2, np.arange(len(queries))
        width = wanted + SPARE
        best, at = np.full((len(queries), width), -np.inf), np.full((len(queries), width), -1)
        least, active, seen = bound.copy(), np.ones(len(queries), bool), np.zeros(len(queries), bool)
        for j in range(order.shape[1]):
            leaf = order[:, j]
            active &= far[every, leaf] <= limit * gaps(least, lengths, self.longest)
            if not active.any():
                break
            seen |= active
            for one in np.unique(leaf[active]).tolist():
                mine = np.flatnonzero(active & (leaf == one))
                lo, hi = self.tree.lo[one], self.tree.hi[one]
                products = np.nan_to_num(queries[mine] @ self.vectors[lo:hi].T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                both = np.concatenate([best[mine], products], axis=1)
                from_ = np.concatenate([at[mine], np.broadcast_to(np.arange(lo, hi), products.shape)], axis=1)
                top = np.argpartition(-both, width - 1, axis=1)[:, :width]
                best[mine], at[mine] = np.take_along_axis(both, top, axis=1), np.take_along_axis(from_, top, axis=1)
            least = np.maximum(bound, np.partition(best, width - wanted, axis=1)[:, width - wanted])
        found: tuple[list, list, list] = ([], [], [])
        ranked = -np.sort(-best, axis=1)
        whole = (at < 0).any(axis=1) | (ranked[:, -1] >= ranked[:, wanted - 1] - 1e-9 * lengths * self.longest)  # few rows, or ties that reach beyond those kept
        for i in np.flatnonzero(seen).tolist():
            near = np.arange(len(self.vectors)) if whole[i] else at[i]
            exact = np.nan_to_num((self.vectors[near] * queries[i]).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            near, exact = near[exact >= bound[i]], exact[exact >= bound[i]]
            counts = self.begin[near + 1] - self.begin[near]
            ids = self.ids[np.repeat(self.begin[near] - np.append(0, np.cumsum(counts))[:-1], counts) + np.arange(counts.sum())]
            score, free = np.repeat(exact, counts), ids != own[i]
            ids, score = ids[free], score[free]
            top = np.lexsort((ids, -score))[: self.k + 1]
            found[0].append(np.full(len(top), i)), found[1].append(ids[top]), found[2].append(score[top])
        return tuple(np.concatenate(x) if x else np.empty(0) for x in found)


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _numpy(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, size)


def _measured(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, size, norm, band, key) of the rows that take part; ``key`` stands for the vector."""
    element = table.schema[vector_col].dataType.elementType.simpleString()
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(f"array<{'float' if element == 'float' else 'double'}>").alias("v"))
    peak = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    sized = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumns({"size": F.size("v"), "peak": peak})
    norm = F.col("peak") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.try_divide(x.cast("double"), F.col("peak")), F.lit(2))))
    key = F.concat(F.hex(F.xxhash64("v")), F.hex(F.hash("v")))
    return sized.withColumn("norm", norm).select("id", "v", "size", "norm", F.floor(F.log2("norm")).try_cast("int").alias("band"), key.alias("key"))


def _without_masses(rows: DataFrame, k: int, total: int) -> DataFrame:
    """``rows`` in which a vector with more than one in MOST_HOT of all rows has only its k + 2 least ids left."""
    hot = materialize(rows.groupBy("key").count().where(F.col("count") > max(total // MOST_HOT, k + 2)).select("key"))
    masses = rows.join(F.broadcast(hot), "key")
    order = Window.partitionBy("key").orderBy("id")
    ids = masses.select("key", "id").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 2).drop("nth")
    one = masses.groupBy("key").agg(*(F.any_value(c).alias(c) for c in rows.columns if c not in ("id", "key")))
    return rows.join(F.broadcast(hot), "key", "left_anti").unionByName(ids.join(one, "key").select(*rows.columns))


def _cells(rows: DataFrame, bands: dict[int, tuple[int, float]], size: int, cell_rows: int) -> tuple[DataFrame, dict]:
    """``rows`` as (id, v, cell), written; and of all cells the rows, boxes and the longest vector of the band."""
    wanted = {b: -(-n // cell_rows) for b, (n, _) in bands.items()}
    shrink = min(1.0, MOST_CELLS / sum(wanted.values()))
    cells = {b: max(1, int(c * shrink)) for b, c in wanted.items()}
    longest = {b: far for b, (_, far) in bands.items()}

    @F.arrow_udf("array<double>")
    def project(v: pa.Array, band: pa.Array) -> pa.Array:
        points = project_vectors(_numpy(v, size), np.array([longest[b] for b in band.to_pylist()]))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(points) * PROJECTED + 1, PROJECTED), pa.int32()), pa.array(points.ravel()))

    thin = F.lit(False)
    for b, c in cells.items():
        if c > 1:
            share = min(1.0, SAMPLE_PER_CELL * c / bands[b][0])
            thin = thin | ((F.col("band") == b) & (F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))))
    sample = rows.where(thin).select("band", project("v", "band").alias("p")).toArrow()
    of, points = sample.column("band").to_numpy(), _numpy(sample.column("p").combine_chunks(), PROJECTED)
    planes, offset, count = {}, {}, 0
    for b in sorted(cells):
        planes[b], offset[b] = Planes(points[of == b], cells[b]), count
        count += planes[b].cells

    @F.arrow_udf("int")
    def place(v: pa.Array, band: pa.Array) -> pa.Array:
        vectors, at = _numpy(v, size), np.array(band.to_pylist())
        out = np.zeros(len(at), np.int32)
        for b in np.unique(at).tolist():
            mine = at == b
            out[mine] = offset[b] + planes[b].place(project_vectors(vectors[mine], longest[b]))
        return pa.array(out)

    placed = materialize(rows.select("id", "v", place("v", "band").alias("cell")))
    band_of = np.repeat([longest[b] for b in sorted(cells)], [planes[b].cells for b in sorted(cells)])

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("cell").to_numpy()
            points = project_vectors(_numpy(batch.column("v"), size), band_of[at])
            order = np.argsort(at, kind="stable")
            one, first, n = np.unique(at[order], return_index=True, return_counts=True)
            if len(one):
                lo, hi = (f.reduceat(points[order], first, axis=0) for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int32()), pa.array(n, pa.int64()), *(pa.array(x) for x in (*lo.T, *hi.T))], names=names)

    names = ["cell", "n", *(f"{side}{i}" for side in ("lo", "hi") for i in range(PROJECTED))]
    schema = "cell int, n bigint, " + ", ".join(f"{c} double" for c in names[2:])
    merged = [F.sum("n").alias("n"), *(F.min(c).alias(c) for c in names if c.startswith("lo")), *(F.max(c).alias(c) for c in names if c.startswith("hi"))]
    seen = placed.select("cell", "v").mapInArrow(boxes, schema).groupBy("cell").agg(*merged).orderBy("cell").toArrow()  # MOST_CELLS rows at most, and one for each band
    column = lambda c: seen.column(c).to_numpy()
    lo, hi = (np.column_stack([column(f"{side}{i}") for i in range(PROJECTED)]) if len(seen) else np.zeros((0, PROJECTED)) for side in ("lo", "hi"))
    return placed, {"cell": column("cell"), "n": column("n"), "least": lo - 1e-9, "most": hi + 1e-9, "longest": band_of[column("cell")]}


def _visits(asked: DataFrame, cells: dict, size: int, k: int, confidence: float, nth: int) -> DataFrame:
    """(query, own, bound, v, cell): the cells that each query visits in round ``nth``."""
    limit = chi_square_quantile(confidence, PROJECTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, QUERY_ROWS):
                batch = whole.slice(start, QUERY_ROWS)
                points, lengths = project_queries(_numpy(batch.column("v"), size))
                far = box_distances(points, cells["least"], cells["most"])
                bound = batch.column("bound").to_numpy()
                promise = cells["longest"] * (1 - far / (2 * PROJECTED))
                order = np.argsort(-promise, axis=1, kind="stable")
                before = np.cumsum(cells["n"][order], axis=1) - cells["n"][order]
                place = np.arange(far.shape[1])
                needed = before < k + 2  # the first round must see some rows
                seen_last = needed | (place < ROUNDS[nth - 1]) if nth else np.zeros_like(needed)
                now = (needed | (place < ROUNDS[nth])) & ~seen_last
                near = np.take_along_axis(far <= limit * gaps(bound[:, None], lengths[:, None], cells["longest"]), order, axis=1)
                row, rank = np.nonzero(now & (near | needed))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(row)) for c in ("query", "own", "bound", "v")), pa.array(cells["cell"][order[row, rank]], pa.int32())],
                    names=["query", "own", "bound", "v", "cell"],
                )

    kind = asked.schema["v"].dataType.simpleString()
    return asked.select("query", "own", "bound", "v").mapInArrow(run, f"query string, own bigint, bound double, v {kind}, cell int")


def _searched(placed: DataFrame, visits: DataFrame, cells: dict, size: int, k: int, confidence: float, cell_rows: int) -> DataFrame:
    """(query, id, score): what the visited blocks hold for each query."""
    spark = placed.sparkSession
    counts = {r[0]: r[1] for r in visits.groupBy("cell").count().collect()}  # MOST_CELLS rows at most, and one for each band
    longest = dict(zip(cells["cell"].tolist(), cells["longest"].tolist(), strict=True))
    layout = [(c, -(-n // cell_rows), -(-counts[c] // VISITS)) for c, n in zip(cells["cell"].tolist(), cells["n"].tolist(), strict=True) if c in counts]
    dealt = F.broadcast(spark.createDataFrame(layout, "cell int, blocks int, copies int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = lambda kind: F.lit(None).cast(kind)
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    vectors = placed.join(dealt, "cell").select("cell", block.alias("block"), every("copies").alias("copy"), F.lit(0).alias("kind"), "id", none("string").alias("query"), none("bigint").alias("own"), none("double").alias("bound"), "v")
    copy = F.pmod(F.xxhash64("query"), F.col("copies")).cast("int")
    queries = visits.join(dealt, "cell").select("cell", every("blocks").alias("block"), copy.alias("copy"), F.lit(1).alias("kind"), none("bigint").alias("id"), "query", "own", "bound", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors_, block_ = None, [], [], None
        for batch in batches:
            place = np.column_stack([batch.column(c).to_numpy() for c in ("cell", "block", "copy", "kind")])
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True):
                if lo == hi:
                    continue
                part, now, kind = batch.slice(lo, hi - lo), tuple(place[lo, :3].tolist()), place[lo, 3]
                if now != key:
                    key, ids, vectors_, block_ = now, [], [], None
                if not kind:
                    ids.append(part.column("id").to_numpy()), vectors_.append(_numpy(part.column("v"), size))
                    continue
                if block_ is None:
                    if not ids:
                        continue  # an empty block of a cell
                    block_ = Block(np.concatenate(ids), np.concatenate(vectors_), longest[now[0]], k)
                    ids, vectors_ = [], []
                for start in range(0, part.num_rows, QUERY_ROWS):
                    some = part.slice(start, QUERY_ROWS)
                    own = some.column("own").fill_null(-(1 << 63)).to_numpy()
                    row, found, score = block_.search(_numpy(some.column("v"), size), own, some.column("bound").to_numpy(), confidence)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("query").take(pa.array(row.astype(np.int64))), pa.array(found.astype(np.int64)), pa.array(score.astype(np.float64))], names=["query", "id", "score"]
                    )

    dealt_out = vectors.unionByName(queries).repartition("cell", "block", "copy").sortWithinPartitions("cell", "block", "copy", "kind")
    return dealt_out.mapInArrow(run, "query string, id bigint, score double")


def nearest_neighbours(
    table: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(query_id, rank, id, score): for rows whose id is divisible by ``query_every``, the k nearest of all other rows.

    Nearness is the inner product in double precision; ties go to the smaller id. Vectors that are null or zero or hold
    null or non-finite components take no part, nor do null ids. Vectors of each length are searched by themselves. Rows
    that repeat an id and its vector are one; an id with several vectors is one query (of the vector that a hash names),
    never its own neighbour, and a candidate with each of them. Products beyond the range of doubles are infinite, and
    those that are no number come last. An empty table gives no rows.
    """
    spark, rows = table.sparkSession, _measured(table, id_col, vector_col)
    kinds = rows.groupBy("size", "band").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()
    found = spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    for size in sorted({r["size"] for r in kinds}):
        bands = {r["band"]: (r["n"], r["longest"]) for r in kinds if r["size"] == size}
        found = found.unionByName(_nearest(rows.where(F.col("size") == size), bands, size, k, query_every, confidence, cell_rows))
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _nearest(rows: DataFrame, bands: dict[int, tuple[int, float]], size: int, k: int, query_every: int, confidence: float, cell_rows: int) -> DataFrame:
    total = sum(n for n, _ in bands.values())
    several = F.min("key") != F.max("key")
    asking = rows.where(F.col("id") % query_every == 0).groupBy("id").agg(F.min_by("v", "key").alias("v"), F.min("key").alias("key"), F.when(several, F.col("id")).alias("own"))
    ids = materialize(asking.withColumn("query", F.concat_ws(":", "key", F.col("own").cast("string"))))
    placed, cells = _cells(_without_masses(rows, k, total), bands, size, cell_rows)
    asked = materialize(ids.groupBy("query").agg(F.any_value("v").alias("v"), F.any_value("own").alias("own"), F.count("*").alias("n")))
    best = None
    for nth in range(len(ROUNDS)):
        if nth and ROUNDS[nth - 1] >= len(cells["cell"]):
            break
        bound = F.lit(float("-inf"))
        if best is not None:
            kth = best.where(F.col("place") == k + 1).select("query", F.col("score").alias("bound"))
            open_ = asked.join(kth, "query", "left").withColumn("bound", F.coalesce("bound", bound))
        else:
            open_ = asked.withColumn("bound", bound)
        visits = materialize(_visits(open_, cells, size, k, confidence, nth))
        if visits.isEmpty():
            continue
        got = _searched(placed, visits, cells, size, k, confidence, cell_rows)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        both = got if best is None else got.unionByName(best.drop("place"))
        best = materialize(both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1))
    if best is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("near"))  # k + 1 at most
    n_ids = sum(n for n, in asked.agg(F.coalesce(F.sum("n"), F.lit(0))).collect())
    met = join_classes(ids.select(F.col("id").alias("query_id"), "query"), asked.select("query", "n").join(lists, "query"), "query", "n", n_ids)
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return met.select("query_id", F.posexplode(others).alias("rank", "r")).select("query_id", (F.col("rank") + 1).alias("rank"), "r.id", "r.score")
