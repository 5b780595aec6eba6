"""Near duplicates by SimHash, compared exactly in tiles (operator 7).

Fingerprints are 64-bit majorities over the XXH64 values of three-word shingles. Equal fingerprints are one
node. Of the others, those within the radius are found by exact comparison of tiles with exclusive-or and bit counts:

* A radius of ``r`` leaves ``m - r`` of ``m`` parts of two linked fingerprints equal, whichever parts the differing
  bits fall into. So fingerprints only have to be compared inside *bands*, which agree on ``m - r`` parts; a
  fingerprint is in ``m over r`` bands. ``m`` follows from the number of fingerprints, so that a band holds a few hundred
  of evenly spread ones at any size; no choice of ``m`` loses a link.
* A band larger than ``TILE`` is dealt over a triangle of cells, each of which compares two chunks of it.
* In a cell, fingerprints are sorted by population count and cut into tiles; tile pairs whose counts differ
  by more than the radius are skipped, as no link can join them.

A cell returns at most one link for each of its rows (to the smallest fingerprint that it reaches there), never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topspin.llm.shared import by_bytes, materialise
from topspin.operators.graph import connected_components

RADIUS = 3
#: Fingerprints of a band that one cell takes as one chunk, and of a tile within a cell.
TILE, SUBTILE = 2048, 256
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is set in over half of the shingles' hash values; no words give zero."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # on bytes, both touch ASCII only
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) >= 3 else [b" ".join(words)]
    counts, total = np.zeros(64, np.int64), max(1, len(words) - 2)
    while (h := np.fromiter(map(_hash, itertools.islice(shingles if not isinstance(shingles, list) else (shingles := iter(shingles)), 1 << 15)), np.uint64)).size:
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id_column, fingerprint long)``, the 64 bits as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            bits = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(bits.view(np.int64))], names=["key", "fingerprint"])

    source = docs.select(F.col(id_column).alias("key"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, fingerprint long").withColumnRenamed("key", id_column)


def _masks(n: int, radius: int) -> list[int]:
    """The bit masks of the bands, as signed integers: the fewest for which an even band holds no more than a few hundred of ``n``."""
    for m in range(radius + 1, radius + 5):
        if n / 2 ** (64 * (m - radius) / m) <= 256:
            break
    cuts = [64 * i // m for i in range(m + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in itertools.pairwise(cuts)]
    return [int(np.uint64(sum(p)).astype(np.int64)) for p in itertools.combinations(parts, m - radius)]


def _reach(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the smallest row that it reaches over the links ``a``-``b``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _small(group: np.ndarray, bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows that stand sorted by ``group``; all groups at once, one distance of rows after another."""
    left, right, d = [], [], 1
    at = np.arange(len(bits))
    while len(at):
        at = at[at + d < len(bits)]
        at = at[group[at + d] == group[at]]
        hit = at[np.bitwise_count(bits[at] ^ bits[at + d]) <= radius]
        left.append(hit)
        right.append(hit + d)
        d += 1
    return np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])


def _tiled(bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(np.bitwise_count(bits), kind="stable")
    bits, count = bits[order], np.bitwise_count(bits[order]).astype(np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(bits), SUBTILE):
        a = bits[i : i + SUBTILE]
        for j in range(i, len(bits), SUBTILE):
            if count[j] - count[min(i + SUBTILE, len(bits)) - 1] > radius:
                break
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ bits[None, j : j + SUBTILE]) <= radius)
            keep = x + i < y + j
            left.append(order[x[keep] + i])
            right.append(order[y[keep] + j])
    return np.concatenate(left), np.concatenate(right)


def _cells(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(band, part, cell, bits)`` sorted by the first three: links within each cell."""
    held: list[pa.RecordBatch] = []

    def links(rows: pa.Table) -> pa.RecordBatch:
        keys = [rows.column(c).to_numpy() for c in ("band", "part", "cell")]
        bits = rows.column("bits").to_numpy().view(np.uint64)
        new = np.ones(len(bits), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        starts = np.flatnonzero(new)
        sizes = np.diff([*starts, len(bits)])
        group = np.repeat(np.arange(len(starts)), sizes)
        few = np.flatnonzero(np.repeat(sizes <= 64, sizes))
        a, b = _small(group[few], bits[few], radius)
        left, right = [few[a]], [few[b]]
        for g in np.flatnonzero(sizes > 64):
            a, b = _tiled(bits[starts[g] : starts[g] + sizes[g]], radius)
            left.append(a + starts[g])
            right.append(b + starts[g])
        to = _reach(len(bits), np.concatenate(left), np.concatenate(right))
        at = np.flatnonzero(to != np.arange(len(bits)))
        whole = bits.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(whole[at]), pa.array(whole[to[at]])], names=["a", "b"])

    for batch in batches:
        # the last cell of a batch may go on in the next one
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "part", "cell")]
        n = batch.num_rows
        same = np.logical_and.reduce([k == k[-1] for k in keys]) if n else np.zeros(0, bool)
        cut = n - int(np.argmin(same[::-1])) if not same.all() else 0
        if not n:
            continue
        if cut == 0 and held and all(h.column(c)[-1] == batch.column(c)[0] for h in held[-1:] for c in ("band", "part", "cell")):
            held.append(batch)
            continue
        held.append(batch.slice(0, cut))
        if sum(h.num_rows for h in held):
            yield links(pa.Table.from_batches(held))
        held = [batch.slice(cut)]
    if sum(h.num_rows for h in held):
        yield links(pa.Table.from_batches(held))


def near_links(nodes: DataFrame, radius: int = RADIUS, column: str = "fingerprint") -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints, enough to join all that are within ``radius`` of each other."""
    n = nodes.count()
    bands = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col(column).bitwiseAND(F.lit(mask)).alias("band")) for i, mask in enumerate(_masks(n, radius))]))
    rows = nodes.select(F.col(column).alias("bits"), bands.alias("at")).select("bits", "at.part", "at.band")
    large = rows.groupBy("part", "band").count().where(F.col("count") > TILE).select("part", "band", F.ceil(F.col("count") / TILE).cast("int").alias("chunks"))
    rows = rows.join(large, ["part", "band"], "left").withColumn("chunk", F.pmod(F.xxhash64("bits"), F.coalesce("chunks", F.lit(1))).cast("int"))
    other = F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)
    cell = F.transform(other, lambda c: F.least(c, F.col("chunk")).cast("long") * (1 << 31) + F.greatest(c, F.col("chunk")))
    rows = rows.select("band", "part", F.explode(cell).alias("cell"), "bits")
    # sorted by bits too, a cell's links go to its smallest fingerprint, as the stars of the component search do
    rows = rows.repartition("band", "part", "cell").sortWithinPartitions("band", "part", "cell", "bits")
    return rows.mapInArrow(lambda batches: _cells(batches, radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(id_column, fingerprint, component_id)``: one row for each row of ``docs``.

    ``fingerprint`` has 16 hexadecimal digits; ``component_id`` is the smallest id reachable over links of at most
    ``radius`` differing bits, the row's own included. A null text counts as empty; texts without words have the
    fingerprint zero and link like any other. A null id never is the smallest; the component of texts that only rows with
    null ids reach is null. Repeated rows stay as they are, other columns are left out.
    """
    marks = materialise(fingerprints(docs, id_column, text_column))
    nodes = marks.groupBy("fingerprint").agg(F.min(id_column).alias("least"))
    found = connected_components(near_links(nodes.select("fingerprint"), radius))
    found = nodes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    found = materialise(found)
    smallest = found.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = found.join(smallest, "component").select("fingerprint", "component_id")
    done = marks.join(classes, "fingerprint")
    return done.select(id_column, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
