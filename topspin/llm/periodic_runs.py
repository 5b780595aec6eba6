"""Runs of words that repeat with a period, found bit-parallel (operator 13).

Words become numbers, and the bits of these numbers become planes: big integers with a bit for each word. For a lag ``q`` the planes are
compared with themselves shifted by ``q`` (exclusive-or), and their differences joined (or): a zero stands where a word equals
the one ``q`` further on. Ands of the zeros with themselves, shifted by 1, 2, 4, ..., leave a bit only where a stretch of zeros is
long enough to make a run.

A text of ``n`` words has ``n / 4`` lags. All up to ``SHORT`` are compared. A longer one is compared only if a run with it can exist: with
``b`` the power of two for which ``b <= q < 2b``, a run of four periods holds a multiple of ``b`` at which a sequence of ``2b`` words starts that
recurs exactly ``q`` words later, and no sooner, as a sequence of at least a period's length is found in a run only at whole periods. So lags
at which no such sequence recurs are left out, and no run is lost. That leaves at most ``min(b, n / b)`` lags for each ``b``, about
four times the root of ``n`` in all; prose has hardly any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topspin.llm.shared import by_bytes

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Up to this lag all lags are compared.
SHORT = 8
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _planes(ids: np.ndarray) -> list[int]:
    """Bit ``i`` of plane ``k`` is bit ``k`` of ``ids[i]``."""
    bits = int(ids.max(initial=0)).bit_length()
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(bits)]


def _ones(plane: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(plane.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))


def _long_lags(ids: np.ndarray) -> list[int]:
    """The lags above ``SHORT`` at which a run can exist, see above."""
    n, b, found = len(ids), 1, set()
    names = ids.astype(np.int64)  # equal names: equal sequences of b words
    while LEAST_PERIODS * b <= n:
        pairs = names[:-b] * (int(names.max(initial=0)) + 1) + names[b:]
        values, names = np.unique(pairs, return_inverse=True)
        if len(values) == len(names):
            break
        if 2 * b > SHORT:
            order = np.argsort(names, kind="stable")
            after = np.full(len(names), -1)
            same = names[order[1:]] == names[order[:-1]]
            after[order[:-1][same]] = order[1:][same]
            at = np.arange(0, len(names), b)
            lags = (after[at] - at)[after[at] >= 0]
            found.update(lags[(lags >= b) & (lags < 2 * b) & (lags > SHORT)].tolist())
        b *= 2
    return sorted(found)


def find_runs(words: list) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of ``words``, by start and period.

    A run is a stretch with smallest period ``q`` that has at least ``max(6, 4 q)`` words and that no neighbouring word extends keeping that period.
    """
    n = len(words)
    if n < LEAST_WORDS:
        return []
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return []
    planes, runs = _planes(ids), []
    for q in [*range(1, min(SHORT, n // LEAST_PERIODS) + 1), *_long_lags(ids)]:
        size = n - q
        differ = 0
        for plane in planes:
            differ |= plane ^ (plane >> q)
        least = max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q)
        equal, have = ~differ & ((1 << size) - 1), 1
        while equal and have < least:
            step = min(have, least - have)
            equal &= equal >> step
            have += step
        if not equal:
            continue
        starts, ends = _ones(equal & ~(equal << 1), size), _ones(equal & ~(equal >> 1), size)
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            root = ids[s : s + q]
            # a smaller period of so long a stretch divides q
            if not any(q % d == 0 and (root[d:] == root[:-d]).all() for d in range(1, q // 2 + 1)):
                runs.append((s, e - s + least + q, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that any run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id_column, n_words, runs, collapsed)``: one row for each row of ``docs``, its whole text compared.

    Words are what stands between ASCII white space (space and 0x09 to 0x0D); ``runs`` are structs of the number of the first word (from
    0), the number of words and the period, by start and period; ``collapsed`` has the words that stay, joined by one space. A null or
    empty text has no words, no runs and an empty ``collapsed``. Repeated rows and null ids stay as they are; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in by_bytes(batches, "text"):
            sizes, found, kept = [], [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode("utf-8", "replace").split()  # of bytes: white space is ASCII only
                runs = find_runs(words)
                sizes.append(len(words))
                found.append([{"start": s, "length": length, "period": q} for s, length, q in runs])
                kept.append(b" ".join(collapse(words, runs)).decode())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(kept, pa.string())], names=["key", "n_words", "runs", "collapsed"])

    source = docs.select(F.col(id_column).alias("key"), F.col(text_column).cast("string").alias("text"))
    schema = f"key {source.schema['key'].dataType.simpleString()}, n_words long, runs array<{RUN}>, collapsed string"
    return source.mapInArrow(run, schema).withColumnRenamed("key", id_column)
