"""Removal of passages that repeat across documents (operator 4): paragraph MinHash banding.

*Paragraphs.* The lines of a text with at least ``least_words`` words. A paragraph's signature has ``BANDS * ROWS`` MinHash values of
its five-word shingles; ``bands_for`` takes the fewest bands that find a pair of similarity ``SIMILARITY`` with probability ``RECALL``.
Paragraphs that collide in a band are joined, and all pairs of distinct ones in a band are verified by the exact Jaccard
similarity of their shingles. Large bands are dealt over a triangle of cells; no pair is left out.

*Passages inside paragraphs* have no borders that both copies share, so documents are also cut where their content says so:
before a word pair whose hash is the least within ``REACH`` words on both sides, about every eleven words. Such a tile is a
paragraph whose only band is all of its words: tiles are compared for equality, by two independent 64-bit hashes.

*Clusters.* Verified links make components. Of each, the occurrence in the smallest document (the first in it) stays, the others go.
Neighbouring ones of a document are taken together, and go if they have ``least_words`` words in all: what is cut out has been
compared, word for word or by similarity, with an earlier occurrence. Shorter repeats are stock phrases; ``least_words`` may be
any number from five on.

No group of copies is ever gathered: copies are one node, and hot bands stand on the split side of joins.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topspin.llm.shared import by_bytes, materialise
from topspin.llm.simhash import _reach
from topspin.operators.graph import connected_components

REACH, SHINGLE, LONGEST = 5, 5, 64
SIMILARITY, RECALL, ROWS = 0.8, 0.99, 2
LEAST_WORDS = 15
#: Paragraphs and shingles of a band that one cell takes as one chunk, and shingles that it counts at a time.
TILE, TILE_SHINGLES, WIDTH = 256, 1 << 19, 4096


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The fewest bands of ``rows`` MinHash values in one of which a pair of that similarity collides with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows) - 1e-9)


BANDS = bands_for(SIMILARITY, RECALL, ROWS)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# what lies beyond is no space
_SPACE = np.zeros(0x3002, bool)
_SPACE[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_BREAK = np.zeros(0x3002, bool)
_BREAK[[*range(10, 14), *range(28, 31), 0x85, 0x2028, 0x2029]] = True
_CHUNK = 1 << 18
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, _CHUNK + 1), _powers(_INVERSE, _CHUNK + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A multiplier for each MinHash function.
_FUNCTIONS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of ``values``, wherever it stands; a range that is longer than ``_CHUNK`` is hashed piece by piece."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        origin = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, origin + _CHUNK, side="right")))
        if ends[at] - origin > _CHUNK:
            sums = np.zeros(1, np.uint64)
            for s in range(int(origin), int(ends[at]), _CHUNK):
                part = values[s : min(s + _CHUNK, int(ends[at]))]
                sums = _mix(sums * _BASE + (part * _UP[: len(part)]).sum(dtype=np.uint64, keepdims=True))
            out[at], at = sums[0], at + 1
            continue
        part = values[origin : ends[to - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _UP[: len(part)], dtype=np.uint64, out=sums[1:])
        a, b = starts[at:to] - origin, ends[at:to] - origin
        out[at:to] = _mix((sums[b] - sums[a]) * _DOWN[a] + (b - a).astype(np.uint64))
        at = to
    return out


class Passages:
    """The words of some texts, one text after another, with their tiles and paragraphs, each by its ``first`` and ``last`` word (exclusive); none goes from one text into another.

    Texts are short, so all of them are worked on at once.
    """

    def __init__(self, *texts: str):
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
        low = np.minimum(points, 0x3001)
        space = np.ones(len(points) + 2, bool)
        space[1:-1] = _SPACE[low]
        #: Places of the words in the texts, joined by a line break.
        self.starts, self.ends = np.flatnonzero(space[:-1] > space[1:]), np.flatnonzero(space[:-1] < space[1:])
        self._breaks = np.flatnonzero(_BREAK[low])
        lower = points.astype(np.uint64)
        lower += ((points - np.uint32(65)) < 26).astype(np.uint64) * np.uint64(32) + np.uint64(1)
        self.words = _ranges(lower, self.starts, self.ends)
        #: Where each text begins, and its first word; the number of all words comes last.
        self.places = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        self.firsts = np.append(np.searchsorted(self.starts, self.places), len(self.words))
        #: The text of each word.
        self.of = np.repeat(np.arange(len(self.places)), np.diff(self.firsts))

    def tiles(self) -> tuple[np.ndarray, np.ndarray]:
        """Stretches of ``SHINGLE`` words at least between cuts."""
        n = len(self.words)
        if n < SHINGLE:
            return _NOTHING
        cut = np.zeros(n + 1, bool)
        cut[self._cuts()] = True
        cut[self.firsts] = True
        bounds = np.flatnonzero(cut)
        pieces = -(-np.diff(bounds) // LONGEST)
        if pieces.max() > 1:
            own = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            bounds = np.append(np.repeat(bounds[:-1], pieces) + LONGEST * own, n)
        long = np.diff(bounds) >= SHINGLE
        return bounds[:-1][long], bounds[1:][long]

    def _cuts(self) -> np.ndarray:
        pairs = _mix(self.words[:-1] * _BASE + self.words[1:])
        # texts stand apart by more than the reach
        inside = self.of[:-1] == self.of[1:]
        place = np.arange(len(pairs)) + REACH * self.of[:-1]
        padded = np.full(len(pairs) + REACH * (len(self.places) + 1), _NONE)
        padded[REACH + place[inside]] = pairs[inside]
        own = padded[REACH:-REACH]
        least = np.ones(len(own), bool)
        for d in range(1, REACH + 1):
            least &= own < padded[REACH - d : REACH - d + len(own)]
            least &= own <= padded[REACH + d : REACH + d + len(own)]
        return np.flatnonzero(least[place] & inside)

    def paragraphs(self, least_words: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.words)
        if n < least_words:
            return _NOTHING
        # a line break stands between texts
        line = np.searchsorted(self._breaks, self.starts)
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(line)) + 1, [n]])
        long = np.diff(bounds) >= least_words
        return bounds[:-1][long], bounds[1:][long]

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return _ranges(self.words, first, last)

    def checks(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A second hash, of other values of the words."""
        return _ranges(_mix(self.words + _INVERSE), first, last)

    def shingles(self) -> np.ndarray:
        count = len(self.words) - SHINGLE + 1
        out = np.zeros(max(0, count), np.uint64)
        for j in range(SHINGLE if count > 0 else 0):
            out = out * _BASE + self.words[j : j + count]
        return _mix(out)


def band_keys(shingles: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A row for each range of ``shingles``, a column for each band. Ranges are in order and don't overlap."""
    least = np.empty((BANDS * ROWS, len(first)), np.uint64)
    values, held = shingles ^ (shingles >> np.uint64(29)), np.full(len(shingles) + 1, _NONE)
    ends = np.stack([first, last], 1).ravel()
    for k, f in enumerate(_FUNCTIONS):
        np.multiply(values, f, out=held[:-1])
        least[k] = np.minimum.reduceat(held, ends)[::2]
    out = np.arange(BANDS, dtype=np.uint64)[:, None] * np.ones(len(first), np.uint64)
    for k in range(ROWS):
        out = _mix(out * _BASE + least[k::ROWS])
    return out.T


class Batch:
    """The passages of some texts: ``of`` tells the text of each tile and then of each paragraph."""

    def __init__(self, texts: list[str | None], least_words: int, tiles: bool = True):
        self.own = Passages(*[t or "" for t in texts])
        self.tiles = self.own.tiles() if tiles else _NOTHING
        self.paragraphs = self.own.paragraphs(least_words)
        self.of = self.own.of[np.concatenate([self.tiles[0], self.paragraphs[0]])]
        self.n_tiles = len(self.tiles[0])

    def hashes(self) -> np.ndarray:
        return np.concatenate([self.own.hashes(*x) for x in (self.tiles, self.paragraphs)])

    def checks(self) -> np.ndarray:
        return np.concatenate([self.own.checks(*x) for x in (self.tiles, self.paragraphs)])

    def words(self, side: int) -> np.ndarray:
        """By their number in their text."""
        return np.concatenate([self.tiles[side], self.paragraphs[side]]) - self.own.firsts[self.of]

    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shingles of all words, and the range of each paragraph."""
        first, last = self.paragraphs
        return self.own.shingles() if len(first) else np.zeros(0, np.uint64), first, last - SHINGLE + 1

    def sets(self) -> tuple[np.ndarray, np.ndarray]:
        """The different shingles of each paragraph, as 32-bit integers, and where each paragraph's begin."""
        values, first, last = self.shingles()
        sizes = last - first
        number = np.repeat(np.arange(len(first)), sizes)
        at = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
        found = np.sort(number.astype(np.uint64) << np.uint64(32) | values[at] >> np.uint64(32))
        found = found[np.diff(found, prepend=_NONE) != 0]
        return found.astype(np.uint32), np.searchsorted(found, np.arange(len(first) + 1, dtype=np.uint64) << np.uint64(32)).astype(np.int32)


Gone = list[tuple[int, int, int, object]]


def spans(text: str, gone: Gone, least_words: int = LEAST_WORDS) -> Gone:
    """``(start, end, words, first document)`` of what to remove; ``gone`` lists ``(first word, last word, hash, first document)``.

    Entries whose hash isn't that of the text's (another row with the same id) don't count.
    """
    return next(spans_of([text], [gone], least_words))


def spans_of(texts: Sequence[str | None], gone: Sequence[Gone | None], least_words: int = LEAST_WORDS) -> Iterator[Gone]:
    """``spans()`` of each text, of many texts at a time; none where there is no text or nothing is gone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= 1 << 20 or i + 1 == len(texts):
            yield from _spans(texts[start : i + 1], gone[start : i + 1], least_words)
            start, held = i + 1, 0


def _spans(texts: Sequence[str | None], gone: Sequence[Gone | None], least_words: int) -> list[Gone]:
    own = Passages(*[t if t and g else "" for t, g in zip(texts, gone, strict=True)])
    entries, of = [], []
    for i, (g, at, n) in enumerate(zip(gone, own.firsts[:-1].tolist(), np.diff(own.firsts).tolist(), strict=True)):
        known = sorted({(a + at, b + at, h % (1 << 64), d) for a, b, h, d in g or () if b <= n})
        entries += known
        of += [i] * len(known)
    first, last, hashes = (np.array([g[i] for g in entries], t) for i, t in enumerate((np.int64, np.int64, np.uint64)))
    same, rest = np.zeros(len(entries), bool), np.arange(len(entries))
    while len(rest):  # those whose ends rise together, then those inside of them
        rising = last[rest] >= np.maximum.accumulate(last[rest])
        at = rest[rising]
        same[at] = own.hashes(first[at], last[at]) == hashes[at]
        rest = rest[~rising]
    runs: list[list] = []
    for i, (a, b, _, d), ok in zip(of, entries, same.tolist(), strict=True):
        if not ok:
            continue
        if runs and runs[-1][3] == i and a <= runs[-1][1]:
            runs[-1][1], runs[-1][2] = max(runs[-1][1], b), min(runs[-1][2], d)
        else:
            runs.append([a, b, d, i])
    out: list[Gone] = [[] for _ in texts]
    for a, b, d, i in runs:
        if b - a >= least_words:
            out[i].append((int(own.starts[a] - own.places[i]), int(own.ends[b - 1] - own.places[i]), b - a, d))
    return out


def cut(text: str, gone: Gone, least_words: int = LEAST_WORDS) -> str:
    """The text without what ``spans`` tells; white space behind a removed span goes with it."""
    return _without(text, spans(text, gone, least_words))


def _without(text: str, removed: Gone) -> str:
    parts, at = [], 0
    for start, end, *_ in removed:
        parts.append(text[at:start])
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
    return ("".join(parts) + text[at:]).strip() if parts else text


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _keys(docs: DataFrame, least_words: int, places: bool) -> DataFrame:
    """``(key, hash)`` and, with ``places``, ``(doc, start, end, check)`` of all tiles and paragraphs: a row with their hash as the key, and one for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            found = Batch(batch.column("text").to_pylist(), least_words)
            hashes = found.hashes()
            shingles, first, last = found.shingles()
            bands = band_keys(shingles, first, last) if len(first) else np.zeros((0, BANDS), np.uint64)
            # each passage once, and each paragraph again for each band
            each = np.concatenate([np.arange(len(hashes)), np.repeat(np.arange(found.n_tiles, len(hashes)), BANDS)])
            columns = [_signed(np.concatenate([hashes, bands.ravel()])), _signed(hashes[each])]
            if places:
                columns += [batch.column("doc").take(pa.array(found.of[each])), *[pa.array(found.words(side)[each].astype(np.int32)) for side in (0, 1)], _signed(found.checks()[each])]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "hash", "doc", "start", "end", "check"][: len(columns)])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"key long, hash long, doc {kind}, start int, end int, check long" if places else "key long, hash long")


def _shingle_sets(docs: DataFrame, least_words: int) -> DataFrame:
    """``(hash, shingles)`` of all paragraphs: their different shingles, as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            found = Batch(batch.column("text").to_pylist(), least_words, tiles=False)
            sets, offsets = found.sets()
            yield pa.RecordBatch.from_arrays([_signed(found.hashes()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sets.view(np.int32)))], names=["hash", "shingles"])

    return docs.mapInArrow(run, "hash long, shingles array<int>")


def _alike(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets of at least ``SIMILARITY``; the sets stand in ``sets`` one after another."""
    values, column = np.unique(sets, return_inverse=True)
    shared = np.bincount(column) > 1
    row, column = np.repeat(np.arange(len(sizes)), sizes)[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    both = np.zeros((len(sizes), len(sizes)), np.float32)
    for at in range(0, int(shared.sum()), WIDTH):
        here = (column >= at) & (column < at + WIDTH)
        held = np.zeros((len(sizes), min(WIDTH, len(values) - at)), np.float32)
        held[row[here], column[here] - at] = 1
        both += held @ held.T
    a, b = np.nonzero(np.triu(both >= SIMILARITY * (sizes[:, None] + sizes[None, :] - both.astype(np.float64)), 1))
    return a, b


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, cell, hash, shingles)`` sorted by the first three: a link from each row of a cell to the least that it reaches."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, (None,)):
        held += [batch] if batch is not None and batch.num_rows else []
        if not held:
            continue
        rows = pa.concat_batches(held)
        keys = [rows.column(c).to_numpy() for c in ("key", "cell")]
        starts = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
        # the last cell of a batch may go on in the next one
        held, ends = ([], [*starts[1:], rows.num_rows]) if batch is None else ([rows.slice(starts[-1])], starts[1:])
        hashes, column = rows.column("hash").to_numpy(), rows.column("shingles")
        offsets, sets = column.offsets.to_numpy(), column.values.to_numpy()
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, end in zip(starts, ends, strict=False):
            if end - start > 1:
                a, b = _alike(sets[offsets[start] : offsets[end]], np.diff(offsets[start : end + 1]))
                to = _reach(end - start, a, b)
                at = np.flatnonzero(to != np.arange(end - start))
                left.append(hashes[start + at])
                right.append(hashes[start + to[at]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def alike_links(members: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between hashes, enough to join all distinct ``(key, hash, shingles)`` of one key that are alike."""
    members = materialise(members)
    count = F.greatest(F.count("*") / TILE, F.sum(F.size("shingles")) / TILE_SHINGLES)
    groups = materialise(members.groupBy("key").agg(F.count("*").alias("n"), F.ceil(count).cast("int").alias("chunks")).where(F.col("n") > 1))
    rows = members.join(groups.select("key", "chunks"), "key")
    chunk = F.pmod(F.xxhash64("hash"), F.col("chunks")).cast("int")
    cell = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.least(c, chunk).cast("long") * (1 << 31) + F.greatest(c, chunk))
    rows = rows.select("key", F.explode(cell).alias("cell"), "hash", "shingles")
    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "hash").mapInArrow(_cells, "a long, b long")


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc, start, end, hash, first_doc)``: tiles and paragraphs, by their words, that occur before by document id and place."""
    source = docs.select(F.col(id_column).alias("doc"), F.col(text_column).cast("string").alias("text")).where(F.col("doc").isNotNull())
    keys = _keys(source, least_words, False).groupBy("key").agg(F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    # repeated texts, and bands in which different texts collide
    keys = materialise(keys.where((F.col("n") > 1) & ((F.col("low") == F.col("key")) | (F.col("low") != F.col("high")))).select("key"))
    rows = materialise(_keys(source, least_words, True).join(keys, "key"))

    collided = rows.where(F.col("key") != F.col("hash"))
    members = materialise(collided.select("key", "hash").distinct())
    sets = _shingle_sets(source, least_words).join(members.select("hash").distinct(), "hash", "left_semi").dropDuplicates(["hash"])
    found = materialise(connected_components(alike_links(members.join(sets, "hash"))))

    near = collided.join(found.select(F.col("node").alias("hash")), "hash", "left_semi").select("doc", "start", "end", "hash", "check").distinct()
    rows = rows.where(F.col("key") == F.col("hash")).select("doc", "start", "end", "hash", "check").unionByName(near)
    rows = rows.join(found.withColumnRenamed("node", "hash"), "hash", "left")
    # texts with equal hashes have to have equal second hashes, but for those that were compared by their shingles
    rows = rows.select("doc", "start", "end", "hash", F.coalesce("component", "hash").alias("component"), F.when(F.col("component").isNull(), F.col("check")).otherwise(0).alias("check"))
    rows = materialise(rows)
    first = materialise(rows.groupBy("component", "check").agg(F.min(F.struct("doc", "start")).alias("first")))
    rows = rows.join(first, ["component", "check"]).where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    return rows.select("doc", "start", "end", "hash", F.col("first.doc").alias("first_doc"))


def _with_gone(docs: DataFrame, id_column: str, text_column: str, least_words: int, how: str) -> tuple[DataFrame, str]:
    """``docs`` with what repeats in them, and the name of that column."""
    taken = {c.lower() for c in docs.columns}
    key, gone = (next(n for n in (f"{'_' * i}{name}" for i in itertools.count()) if n not in taken) for name in ("gone_key", "gone"))
    found = repeats(docs, id_column, text_column, least_words)
    found = found.groupBy(F.col("doc").alias(key)).agg(F.collect_set(F.struct("start", "end", "hash", "first_doc")).alias(gone))
    return docs.join(found, docs[id_column] == found[key], how), gone


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``(id_column, start, end, n_words, first_<id_column>)``: the passages to remove, by code points of the text.

    The document named last is the smallest of those that hold earlier occurrences of the passage's parts (it may be the same document). Null and empty texts
    and rows with a null id have none. Rows with one id and text are one document; where texts differ, each is judged by its own
    words.
    """
    source = docs.select(F.col(id_column).alias("doc"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            lists = batch.column("gone")
            each = zip(*[lists.flatten().field(i).to_pylist() for i in range(4)], strict=True)
            gone = [list(itertools.islice(each, n)) for n in pc.list_value_length(lists).fill_null(0).to_pylist()]
            found = spans_of(batch.column("text").to_pylist(), gone, least_words)
            out = [(doc, *s) for doc, removed in zip(batch.column("doc").to_pylist(), found, strict=True) for s in removed]
            if out:
                kinds = [batch.schema.field("doc").type, pa.int64(), pa.int64(), pa.int64(), batch.schema.field("doc").type]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc", "start", "end", "n_words", "first_doc"])

    found, _ = _with_gone(source, "doc", "text", least_words, "inner")
    found = found.select("doc", "text", "gone").mapInArrow(run, f"doc {kind}, start long, end long, n_words long, first_doc {kind}")
    return found.select(F.col("doc").alias(id_column), "start", "end", "n_words", F.col("first_doc").alias(f"first_{id_column}"))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated passages cut out of the texts; all rows and all other columns stay, whatever they are called."""

    @F.pandas_udf("string")
    def rest(texts: pd.Series, gone: pd.Series) -> pd.Series:
        lists = [None if g is None else [(x["start"], x["end"], x["hash"], x["first_doc"]) for x in g] for g in gone]
        return pd.Series([t if t is None else _without(t, removed) for t, removed in zip(texts, spans_of(list(texts), lists, least_words), strict=True)], dtype=object)

    joined, gone = _with_gone(docs, id_column, text_column, least_words, "left")
    text = F.when(F.col(gone).isNotNull(), rest(docs[text_column].cast("string"), F.col(gone))).otherwise(docs[text_column])
    return joined.select(*[text.alias(c) if c == text_column else docs[c] for c in docs.columns])
