"""Near duplicates among embeddings by the signs of random hyperplanes (operator 12).

Equal vectors are one node, with the number of its rows. Each node gets, for each of several tables, the signs of its products
with ``bits`` random vectors. Two vectors at an angle ``a`` agree in one sign with probability ``1 - a / pi``, so in a table with
``(1 - a / pi) ^ bits``. The bits follow from the number of nodes, so that an even bucket holds a few hundred at any size; the number of tables
follows from the bits, so that a pair at the threshold is missed with a probability of at most ``MISS``, and a closer one with less.

All nodes of a bucket are compared, by their cosine in doubles. A bucket larger than ``TILE`` is dealt over a triangle of cells, each of which
compares two chunks of it. A pair that meets in several tables counts in the first, which its signatures tell. A cell returns at most a row
for each of its nodes: the number of rows it is linked with, and the smallest node that it reaches there. So the pairs of a group are
compared, but never written. Components of those links are found by a distributed search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topspin.llm.shared import materialise
from topspin.operators.graph import connected_components

THRESHOLD = 0.95
#: The probability that a pair just at the threshold meets in no table.
MISS = 5e-5
#: Nodes of a bucket that one cell takes as one chunk; nodes of an even bucket.
TILE, EVEN = 2048, 512
SEED = 20_011


def tables_for(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """The number of signs in a table, and of tables, for ``n`` nodes."""
    bits = min(31, max(1, round(math.log2(max(n, 1) / EVEN)))) if n > EVEN else 1
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows of doubles; shorter ones end in zeros, which leaves cosines as they are."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim)[None] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _signatures(batches: Iterator[pa.RecordBatch], dim: int, bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    planes = np.random.default_rng(SEED).standard_normal((dim, bits * tables))
    weights = 1 << np.arange(bits, dtype=np.int64)
    for batch in batches:
        for s in range(0, batch.num_rows, 4096):
            part = batch.slice(s, 4096)
            signs = (_units(_matrix(part.column("v"), dim)) @ planes > 0).reshape(-1, tables, bits)
            signature = (signs @ weights).astype("<i4")
            columns = [part.column(c) for c in ("h1", "h2", "n", "v")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in signature], pa.binary())], names=["h1", "h2", "n", "v", "signature"])


def _close(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the units ``x`` and ``y`` within the threshold that agree in no table before ``table``."""
    i, j = np.nonzero(x @ y.T >= threshold)
    new = np.ones(len(i), bool)
    for t in range(table):
        new[new] = a[i[new], t] != b[j[new], t]
    return i[new], j[new]


def _solve(batches: Iterator[pa.RecordBatch], dim: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``(tbl, bucket, cell)``: what each node is linked with in its cell."""
    held: list[pa.RecordBatch] = []
    key = None

    def links() -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(held).combine_chunks()
        if len(rows) < 2:
            return None
        chunk = rows.column("chunk").to_numpy()
        column = rows.column("v").chunk(0)
        units = _units(_matrix(column, dim))
        signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), "<i4").reshape(len(rows), -1)
        n, table = rows.column("n").to_numpy(), key[0]
        first, second = key[2] >> 31, key[2] & ((1 << 31) - 1)
        low, high = np.flatnonzero(chunk == first), np.flatnonzero(chunk == second)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(0, len(low), TILE):
            for t in range(s if first == second else 0, len(high), TILE):
                p, q = low[s : s + TILE], high[t : t + TILE]
                i, j = _close(units[p], units[q], signature[p], signature[q], table, threshold)
                i, j = p[i], q[j]
                once = i < j if first == second else slice(None)
                left.append(i[once])
                right.append(j[once])
        i, j = np.concatenate(left), np.concatenate(right)
        if not len(i):
            return None
        links = np.bincount(i, n[j], len(n)) + np.bincount(j, n[i], len(n))
        to = np.arange(len(n))
        while True:  # the smallest row that each row reaches
            least = np.minimum(to[i], to[j])
            new = to.copy()
            for at in (i, j, to[i], to[j]):
                np.minimum.at(new, at, least)
            new = new[new]
            if (new == to).all():
                break
            to = new
        at = np.flatnonzero(links)
        h1, h2 = rows.column("h1").to_numpy(), rows.column("h2").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (h1[at], h2[at], links[at].astype(np.int64), h1[to[at]], h2[to[at]])], names=["h1", "h2", "links", "to1", "to2"])

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("tbl", "bucket", "cell")], 1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
        for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
            now = tuple(keys[s].tolist())
            if now != key:
                if held and (found := links()) is not None:
                    yield found
                held.clear()
                key = now
            held.append(batch.slice(s, e - s))
    if held and (found := links()) is not None:
        yield found


def _usable(vectors: DataFrame, vector_column: str) -> DataFrame:
    """``vectors`` with ``v`` (null where the vector can't be linked) and the two halves of its hash."""
    kind = vectors.schema[vector_column].dataType
    element = "float" if kind.simpleString() == "array<float>" else "double"
    v = F.col(vector_column).cast(f"array<{element}>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.withColumn("v", F.when(fine, v))
    return rows.withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")))


def near_links(nodes: DataFrame, dim: int, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """``(h1, h2, links, to1, to2)`` for ``nodes`` ``(h1, h2, n, v)``: in each bucket, the rows a node is linked with and the smallest node that it reaches."""
    bits, tables = tables_for(nodes.count(), threshold, miss)
    signed = nodes.mapInArrow(lambda b: _signatures(b, dim, bits, tables), f"h1 long, h2 long, n long, v {nodes.schema['v'].dataType.simpleString()}, signature binary")
    signed = materialise(signed)
    number = lambda t: F.conv(F.hex(F.reverse(F.substring("signature", t * 4 + 1, 4))), 16, 10).cast("long")
    buckets = F.explode(F.array(*[F.struct(F.lit(t).alias("tbl"), number(t).alias("bucket")) for t in range(tables)]))
    keys = signed.select("h1", buckets.alias("at")).select("at.tbl", "at.bucket")
    large = keys.groupBy("tbl", "bucket").count().where(F.col("count") > TILE).select("tbl", "bucket", F.ceil(F.col("count") / TILE).cast("long").alias("chunks"))
    rows = signed.select("*", buckets.alias("at")).select("h1", "h2", "n", "v", "signature", "at.tbl", "at.bucket").join(large, ["tbl", "bucket"], "left")
    chunks = F.coalesce("chunks", F.lit(1))
    rows = rows.withColumn("chunk", F.pmod("h2", chunks))
    cell = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda c: F.least(c, F.col("chunk")) * (1 << 31) + F.greatest(c, F.col("chunk")))
    rows = rows.select("tbl", "bucket", F.explode(cell).alias("cell"), "chunk", "h1", "h2", "n", "v", "signature")
    rows = rows.repartition("tbl", "bucket", "cell").sortWithinPartitions("tbl", "bucket", "cell", "h1", "h2")
    return rows.mapInArrow(lambda b: _solve(b, dim, threshold), "h1 long, h2 long, links long, to1 long, to2 long")


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """``(id_column, n_links, component_id, kept)``: one row for each row of ``vectors``.

    ``n_links`` counts the other rows whose vectors have a cosine of at least ``threshold``; ``component_id`` is the smallest id reachable over such
    links, the row's own included; ``kept`` tells whether that is its own. None below the threshold is linked; ``miss`` bounds the
    probability that a link is missed. Vectors that are null, empty, zero or hold null or non-finite components are linked with nothing. Rows with equal
    vectors are linked with each other, whatever their ids. Vectors of different lengths are compared as if they ended in zeros. A null id
    never is the smallest; a component of null ids only has a null id and is kept. Other columns are left out.
    """
    rows = materialise(_usable(vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector")), "vector").select("id", "h1", "h2", "v"))
    usable = rows.where(F.col("v").isNotNull())
    nodes = materialise(usable.groupBy("h1", "h2", "v").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    dim = nodes.agg(F.max(F.size("v"))).first()[0] or 1
    found = materialise(near_links(nodes.select("h1", "h2", "n", "v"), dim, threshold, miss))
    node = lambda a, b: F.struct(F.col(a).alias("h1"), F.col(b).alias("h2"))
    stars = connected_components(found.select(node("h1", "h2").alias("a"), node("to1", "to2").alias("b")))
    counts = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    stars = stars.select("node.h1", "node.h2", "component")
    own = nodes.select("h1", "h2", "n", "least").join(counts, ["h1", "h2"], "left").join(stars, ["h1", "h2"], "left")
    own = materialise(own.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "least", F.coalesce("component", node("h1", "h2")).alias("component")))
    smallest = own.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = own.join(smallest, "component").select("h1", "h2", "n_links", "component_id")
    done = rows.select("id", "h1", "h2").join(classes, ["h1", "h2"], "left")
    linked = F.col("h1").isNotNull()
    done = done.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(linked, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return done.withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))
