"""Exact top-k search by inner product: a Voronoi join (operator 10).

After Lu et al. ("Efficient processing of k nearest neighbor joins using MapReduce", 2012), with inner products in place
of distances:

1. Pivots (a bounded sample) divide queries and data into cells. Each task packs the vectors of a cell that it meets
   into blocks, sorted by their distance from the pivot; nothing is gathered by cell, so a cell of any size is only more blocks.
2. The summary of the data has, for each cell, the ``k + 1`` smallest distances from its pivot; that of the queries their
   largest norm and distance from the pivot. By Cauchy and Schwarz, ``q.x`` is at least ``q.c - |q||x - c|`` and at
   most ``q.c + |q||x - c|`` for a vector ``x`` at the pivot ``c``. So the summaries give each cell of queries a score that ``k``
   vectors are sure to reach, and each block the most that it can reach.
3. A block goes only to those cells of queries for which it can reach that score. There it is multiplied with the packs of
   queries, and each task keeps the best ``k`` for each query that it has met; a last window merges those. The queries of a large cell
   are dealt out in groups.

Scores are integers and exact; bounds are widened by a millionth, which covers their rounding. Vectors whose products might not fit
into 64 bits are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topspin.llm.shared import materialise

SCALE = 1024
#: Pivots: the square root of the rows divided by eight, within these. The summaries that reach the driver have ``k + 1`` numbers for each, the limits that
#: are broadcast a row of 16 bytes for each pair.
PIVOTS = (64, 1024)
BLOCK, PACK = 512, 256
#: Queries of a cell that a block meets at one task.
GROUP = 2048
#: Vectors that a task packs at once.
WINDOW = 32_768
#: Up to this magnitude products of 4,096 components are exact in doubles.
_EXACT = 1 << 20


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``(id, v array<long>)``: components times 1024, rounded down. Vectors that are null or hold a null or non-finite component, and rows with a null id, are left out."""
    source = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return source.where(fine).select("id", F.transform("x", lambda v: F.floor(v * SCALE).cast("long")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros, which leaves inner products as they are."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim), np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    for i, n in enumerate(lengths):
        out[i, :n] = flat[at[i] : at[i + 1]]
    return out


def _cells(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and the distance from it."""
    x = m.astype(np.float64)
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    cell = squares.argmin(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def _pack(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``size`` vectors of one cell, nearest to the pivot first."""
    dim = pivots.shape[1]

    def blocks(rows: pa.Table) -> pa.RecordBatch:
        column = rows.column("v").combine_chunks()
        m, ids = _matrix(column if isinstance(column, pa.Array) else column.chunk(0), dim), rows.column("id").to_numpy()
        cell, far = _cells(m, pivots)
        order = np.lexsort((ids, far, cell))
        starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
        out = []
        for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
            for s in range(a, b, size):
                at = np.sort(order[s : min(b, s + size)])
                at = at[np.argsort(ids[at], kind="stable")]
                near, norms = far[order[s : min(b, s + size)]], np.sqrt((m[at].astype(np.float64) ** 2).sum(1))
                out.append((int(cell[at[0]]), ids[at].astype("<i8").tobytes(), m[at].astype("<i8").tobytes(), float(near[0]), float(near[-1]), float(norms.max()), near.astype("<f8").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.binary()), strict=True)], names=["cell", "ids", "rows", "nearest", "farthest", "norm", "distances"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= WINDOW:
            yield blocks(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield blocks(pa.Table.from_batches(held))


def _packed(rows: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    return rows.mapInArrow(lambda b: _pack(b, pivots, size), "cell int, ids binary, rows binary, nearest double, farthest double, norm double, distances binary")


def _merge(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    first = np.flatnonzero(np.diff(query, prepend=query[0] - 1)) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff([*first, len(query)]))
    keep = rank < k
    return query[keep], score[keep], ids[keep]


def _solve(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a pack of queries and a block: the best ``k`` of each query among all blocks that the task has met."""
    best = tuple(np.zeros(0, np.int64) for _ in range(3))
    new: list[tuple[np.ndarray, ...]] = []
    held = 0
    for batch in batches:
        for q_ids, q_rows, ids, rows in zip(*(batch.column(c) for c in ("q_ids", "q_rows", "ids", "rows")), strict=True):
            q_ids, ids = np.frombuffer(q_ids.as_buffer(), "<i8"), np.frombuffer(ids.as_buffer(), "<i8")
            q, x = np.frombuffer(q_rows.as_buffer(), "<i8").reshape(-1, dim), np.frombuffer(rows.as_buffer(), "<i8").reshape(-1, dim)
            small = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < _EXACT and dim <= 4096
            score = (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if small else q @ x.T
            other = q_ids[:, None] != ids[None]
            if len(ids) > k + 1:
                # one of the k + 1 best may be the query itself
                least = np.partition(score, -(k + 1), axis=1)[:, -(k + 1)]
                other &= score >= least[:, None]
            i, j = np.nonzero(other)
            found = _merge(q_ids[i], score[i, j], ids[j], k)
            new.append(found)
            held += len(found[0])
            if held > 200_000:
                best = _merge(*(np.concatenate(c) for c in zip(best, *new, strict=True)), k)
                new, held = [], 0
    best = _merge(*(np.concatenate(c) for c in zip(best, *new, strict=True)), k)
    for s in range(0, len(best[0]), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 10_000]) for c in best], names=["query_id", "score", "vec_id"])


def _limits(cells: list, summary: list, centres: np.ndarray, k: int) -> pa.Table:
    """``(cell, q_cell, groups, need)``: for each cell of queries and each cell of data the distance from its pivot that a block's farthest vector needs, at least, to matter."""
    dim = centres.shape[1]
    ends = centres[[r.cell for r in summary]].reshape(-1, dim)
    near, lengths, norms = np.array([r.distance for r in summary], np.float64), np.linalg.norm(ends, axis=1), np.linalg.norm(centres, axis=1)
    out = []
    for s in range(0, len(cells), 64):
        part = cells[s : s + 64]
        # a query q of a cell has q.c >= p.c - radius * |c|, with p the cell's own pivot
        own, radius, norm = centres[[r.cell for r in part]], np.array([r.radius for r in part])[:, None], np.array([r.norm for r in part])[:, None]
        least = np.full((len(part), 1), -np.inf)
        if len(near) > k:
            sure = own @ ends.T - radius * lengths - norm * near
            least = np.partition(sure, -(k + 1), axis=1)[:, -(k + 1)][:, None]
        most = own @ centres.T + radius * norms
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(norm > 0, (least - most) / norm, np.where(least <= most, -1.0, np.inf))
        need = need - 1e-6 * (1 + np.abs(need)) - 1e-3
        i, j = np.nonzero(need < np.inf)
        cell, groups = np.array([r.cell for r in part], np.int32), np.array([r.groups for r in part], np.int32)
        out.append(pa.table({"cell": pa.array(j.astype(np.int32)), "q_cell": cell[i], "groups": groups[i], "need": need[i, j]}))
    return pa.concat_tables(out)


def _search(data: DataFrame, asked: DataFrame, k: int, pivots: int | None) -> DataFrame | None:
    """``(query_id, rank, vec_id, score)`` for rows ``(id, v)`` whose ids are unique; a query with the id of a row isn't compared with it. None without a vector."""
    spark = data.sparkSession
    square = lambda df: df.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x)), F.count("*")).first()
    (dim, largest, n), (own, longest, _) = square(data), square(asked)
    dim = max(dim or 0, own or 0)
    if (largest or 0.0) ** 0.5 * (longest or 0.0) ** 0.5 >= 2.0**63 * (1 - 1e-6):
        raise ValueError("inner products of these vectors may not fit into 64 bits")
    pivots = pivots or min(PIVOTS[1], max(PIVOTS[0], int(n**0.5 / 8)))
    sample = data.orderBy(F.xxhash64("id"), "id").limit(pivots).collect() if dim else []  # bounded by ``pivots``
    if not sample:
        return None
    centres = np.unique(np.array([[*r.v, *[0] * (dim - len(r.v))] for r in sample], np.float64), axis=0)
    blocks, packs = materialise(_packed(data, centres, BLOCK)), materialise(_packed(asked, centres, PACK))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, d in zip(batch.column("cell").to_pylist(), batch.column("distances"), strict=True):
                least[cell] = np.sort(np.concatenate([least.get(cell, np.zeros(0)), np.frombuffer(d.as_buffer(), "<f8")[: k + 1]]))[: k + 1]
        cells = [c for c, d in least.items() for _ in d]
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(np.concatenate([np.zeros(0), *least.values()]))], names=["cell", "distance"])

    window = Window.partitionBy("cell").orderBy("distance")
    summary = blocks.select("cell", "distances").mapInArrow(nearest, "cell int, distance double").withColumn("n", F.row_number().over(window)).where(F.col("n") <= k + 1).collect()
    groups = F.ceil(F.sum(F.octet_length("ids") / 8) / GROUP).cast("int").alias("groups")
    cells = packs.groupBy("cell").agg(F.max("farthest").alias("radius"), F.max("norm").alias("norm"), groups).collect()
    if not cells:
        return None
    limits = spark.createDataFrame(_limits(cells, summary, centres, k))
    sent = blocks.join(F.broadcast(limits), "cell").where(F.col("farthest") >= F.col("need"))
    sent = sent.select("q_cell", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("q_group"), "ids", "rows")
    dealt = spark.createDataFrame([(int(r.cell), r.groups) for r in cells], "cell int, groups int")
    asked = packs.join(F.broadcast(dealt), "cell").select(F.col("cell").alias("q_cell"), F.pmod(F.xxhash64("ids"), F.col("groups")).cast("int").alias("q_group"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    found = sent.join(asked, ["q_cell", "q_group"]).mapInArrow(lambda b: _solve(b, dim, k), "query_id long, score long, vec_id long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _numbered(data: DataFrame) -> DataFrame:
    """``data`` with ``row``, a number of its own for each row, in the order of ids."""
    ranged = materialise(data.repartitionByRange("id", F.xxhash64("v")).withColumn("part", F.spark_partition_id().cast("long")))
    place = F.row_number().over(Window.partitionBy("part").orderBy("id", F.xxhash64("v"), "v"))
    return materialise(ranged.select("id", "v", (F.col("part") * (1 << 33) + place).alias("row")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", pivots: int | None = None) -> DataFrame:
    """``(query_id, rank int from 1, vec_id, score)``: for each query its ``k`` best of the rows of ``vectors``, but for its own row.

    Vectors become integers by ``floor(1024 * x)``. Ties go to the smaller id. A query without another usable vector has
    no row; fewer than ``k`` others give fewer rows. Vectors of different lengths are compared as if they ended in zeros. Ids
    are whole numbers. Rows that share an id are rows of their own: each is a candidate, and a query's own row is one with its id and (integer) vector; a query that is
    there twice has its rows twice. ``ValueError`` if the largest squared length of the integer vectors reaches 2^63, as their products might not be whole then.
    """
    spark = vectors.sparkSession
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    none = spark.createDataFrame([], schema)
    data, asked = usable(vectors, id_column, vector_column), usable(queries, id_column, vector_column)
    once = lambda df: df.groupBy("id").count().where("count > 1").isEmpty()  # only ids are shuffled to find out
    if once(data) and once(asked):
        found = _search(data, asked, k, pivots)
        return none if found is None else found
    rows = _numbered(data)
    own = rows.groupBy("id", "v").agg(F.min("row").alias("row"))
    # queries that aren't rows of the data have numbers of their own, below all others
    asked = asked.groupBy("id", "v").agg(F.count("*").cast("int").alias("copies")).join(own, ["id", "v"], "left")
    asked = materialise(asked.withColumn("row", F.coalesce("row", -1 - F.monotonically_increasing_id())))
    found = _search(rows.select(F.col("row").alias("id"), "v"), asked.select(F.col("row").alias("id"), "v"), k, pivots)
    if found is None:
        return none
    named = found.join(rows.select(F.col("row").alias("vec_id"), F.col("id").alias("own_id")), "vec_id").drop("vec_id")
    named = named.join(asked.select(F.col("row").alias("query_id"), F.col("id").alias("asked_id"), "copies"), "query_id")
    return named.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(F.col("asked_id").alias("query_id"), "rank", F.col("own_id").alias("vec_id"), "score")
