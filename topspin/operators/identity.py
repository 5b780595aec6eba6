"""Entity resolution: finding, queueing, merging, splitting and repairing players.

Candidates always come from equi-joins on blocking keys (external ids, aliases, last names, trigrams); similarity is only
worked out for candidates.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topspin.functions.names import compare_names, first_name, fuller, is_abbreviated, last_name, name_similarity, search_variants, tokens, trigrams
from topspin.operators.graph import connected_components
from topspin.operators.matches import sides
from topspin.operators.tables import fill_null, first_by, insert_missing, remap
from topspin.schema import AUTO_MATCH, LIKELY_MATCH, STRONG_MATCH, SUGGEST
from topspin.sources.sinks import durable, sealed


#: Counters of trigrams by hash, which put them in order; sizes up to which sets meet by several trigrams at once.
COUNTERS, LONG = 1 << 16, 64


def _signatures(batches: Iterator[pa.RecordBatch], threshold: float, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Keys of each set of trigrams (``id``, ``grams``), with its size, 128 bits of its trigrams, and how many of them share a bit."""
    level = 4 if threshold >= 0.95 else 3 if threshold >= 0.9 else 2
    small, known, chosen = math.floor((level - 1) / threshold**2 + 1e-9), {}, {}

    def gram(g: str) -> tuple[int, int]:
        raw = g.encode()
        known[g] = out = int(counts[zlib.crc32(raw) % COUNTERS]), int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest())
        return out

    for batch in batches:
        at, keys, facts = [], [], []
        for i, grams in enumerate(batch.column("grams").to_pylist()):
            size = len(grams)
            if not size:
                continue
            order = sorted(known.get(g) or gram(g) for g in grams)
            bits = 0
            for _, h in order:
                bits |= 1 << (h & 127)
            least = math.ceil(threshold * size - 1e-9)
            hashes, own = np.array([h for _, h in order[: size - least + level]], np.uint64), []
            if size <= small or size >= LONG * threshold:
                own.append(hashes[: size - least + 1])
            if least >= level and size <= LONG:
                n = len(hashes)
                if n not in chosen:
                    chosen[n] = np.array(list(itertools.combinations(range(n), level))).T
                mixed = np.full(chosen[n].shape[1], level, np.uint64)
                for place in chosen[n]:
                    mixed = (mixed ^ hashes[place]) * np.uint64(0x9E3779B97F4A7C15)
                own.append(mixed ^ (mixed >> np.uint64(32)))
            own = np.concatenate(own)
            at.append(np.full(len(own), i))
            keys.append(own)
            facts += [(size, bits & (1 << 64) - 1, bits >> 64, size - bits.bit_count())] * len(own)
        if at:
            size, low, high, spare = np.array(facts, np.uint64).T
            columns = [pa.array(np.concatenate(keys).view(np.int64)), batch.column("id").take(pa.array(np.concatenate(at))), pa.array(size.astype(np.int32)), pa.array(low.copy().view(np.int64)), pa.array(high.copy().view(np.int64)), pa.array(spare.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "size", "low", "high", "spare"])


def trigram_matches(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``(left_id, right_id, similarity)`` of names (``id``, ``name``) whose trigram similarity reaches the threshold.

    Names that share the trigrams of a key meet. With the trigrams of each name in one order (rare ones first), the first ``k`` that a match has in common stand, in both names, among
    the first ``n - ceil(threshold * n) + k`` of n; a key is any ``k`` of those (two, or three or four for high thresholds, so that names which only happen to share some seldom meet; one for names with very few or very many trigrams). Of those who meet, the
    bits of their trigrams bound what they can share, before any name is read again.
    """
    return _trigram_named(left, right, threshold).select("left_id", "right_id", "similarity")


def _spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt by ``columns`` in a given number of partitions: names are few bytes but much work, and adaptive execution, which counts bytes, would leave them to a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*columns))


def _trigram_named(left: DataFrame, right: DataFrame, threshold: float, others: bool = False) -> DataFrame:
    """``trigram_matches()`` with ``left_name`` and ``right_name``. Several names may share an id: each is compared. With ``others``, a name doesn't meet itself."""
    a = durable(_spread(left.select("id", "name"), "name"))
    b = a if right is left else durable(_spread(right.select("id", "name"), "name"))
    mark = lambda df, asked, known: df.select("id", "name", F.lit(asked).alias("asked"), F.lit(known).alias("known"))
    both = mark(a, True, True) if b is a else mark(a, True, False).unionByName(mark(b, False, True))
    # names of both sides have their keys made once
    every = durable(both.groupBy("id", "name").agg(F.max("asked").alias("asked"), F.max("known").alias("known")).select(F.struct("id", "asked", "known").alias("id"), "name"))
    bucket = F.crc32(F.encode("g", "UTF-8")) % COUNTERS
    counts = np.zeros(COUNTERS, np.int64)
    for r in every.select(F.explode(trigrams(F.col("name"))).alias("g")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect():  # COUNTERS rows at most
        counts[r.bucket] = r.n
    rows = _spread(every, "name").select("id", trigrams(F.col("name")).alias("grams"))
    keyed = rows.mapInArrow(lambda x: _signatures(x, threshold, counts), f"key long, id {every.schema['id'].dataType.simpleString()}, size int, low long, high long, spare int")
    # most keys are one name's, which meets no other; a name meets itself where it stands on both sides
    alone = F.col("id.asked") & F.col("id.known") if not others else F.lit(False)
    keyed = durable(keyed.withColumn("shared", F.count("*").over(Window.partitionBy("key"))).where((F.col("shared") > 1) | alone).drop("shared"))
    side = lambda s, own: keyed.where(F.col(f"id.{own}")).select("key", F.col("id.id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in ("size", "low", "high", "spare")])
    met = side("left", "asked").join(side("right", "known"), "key")
    common = F.bit_count(F.col("left_low").bitwiseAND(F.col("right_low"))) + F.bit_count(F.col("left_high").bitwiseAND(F.col("right_high"))) + F.least("left_spare", "right_spare")
    total = F.col("left_size") + F.col("right_size")
    if others:
        met = met.where(~reduce(Column.__and__, [F.col(f"left_{c}") == F.col(f"right_{c}") for c in ("id", "size", "low", "high")]))
    pairs = met.where(common * (1 + threshold) >= total * threshold - 1e-6).select("left_id", "right_id").distinct()
    named = lambda df, s: df.select(F.col("id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name"))
    rows = pairs.join(named(a, "left"), "left_id").join(named(b, "right"), "right_id")
    rows = rows.select("left_id", "right_id", "left_name", "right_name", trigrams(F.col("left_name")).alias("left_set"), trigrams(F.col("right_name")).alias("right_set"))
    both = F.size(F.array_intersect("left_set", "right_set"))
    share = both / (F.size("left_set") + F.size("right_set") - both)
    return rows.select("left_id", "right_id", "left_name", "right_name", share.alias("similarity")).where(F.col("similarity") >= threshold)


def fuzzy_matches(incoming: DataFrame, players: DataFrame, least: float = SUGGEST) -> DataFrame:
    """``(id, other, score)``: names with similar trigrams, whatever the last name; for names without a sure one among those, also the ones with the same last name."""
    near = durable(trigram_matches(incoming, players, least))
    sure = near.where(F.col("similarity") >= AUTO_MATCH).select(F.col("left_id").alias("id")).distinct()
    rest = incoming.select("id", "name", last_name(F.col("name")).alias("block")).where(F.col("block") != "").join(sure, "id", "left_anti")
    named = players.select(F.col("id").alias("other"), F.col("name").alias("other_name"), last_name(F.col("name")).alias("block"))
    same = rest.join(named, "block").select("id", "other", compare_names("name", "other_name").alias("score")).where(F.col("score") >= least)
    both = near.select(F.col("left_id").alias("id"), F.col("right_id").alias("other"), F.col("similarity").alias("score")).unionByName(same)
    return both.groupBy("id", "other").agg(F.max("score").alias("score"))


#: Names of a block that one cell compares with those of another; pairs of a cell that are looked at again at once, pairs whose windows are, from how many on; and letters up to which names are.
BLOCK, AGAIN, WINDOWED, FEW, LETTERS = 1024, 1 << 17, 1 << 13, 64, 63


class _Letters:
    """Of each name how often it has a letter (by code modulo 32), its length, that of its words with single blanks, the first four letters, whether the first word is a single letter, and masks for common subsequences."""

    def __init__(self, names: list[str]):
        self.names, words = names, [n.split() for n in names]
        lengths = lambda x: np.fromiter(map(len, x), np.int64, len(names))
        self.size, self.plain = lengths(names), lengths(map(" ".join, words))
        self.one = np.array([bool(w) and len(w[0].rstrip(".")) == 1 for w in words], bool)
        self._sorted = [" ".join(sorted(w)) for w in words]
        codes, owner, at = self._spelt(names, self.size)
        self.counts = np.bincount(owner * 32 + (codes & 31), minlength=len(names) * 32).reshape(-1, 32)
        self.first = np.full((len(names), 4), -1)
        self.first[owner[at < 4], at[at < 4]] = codes[at < 4]

    @staticmethod
    def _spelt(texts: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The codes of all texts' letters, whose they are, and their places."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), size)
        return codes, owner, np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)

    @cached_property
    def plainly(self) -> tuple[np.ndarray, np.ndarray]:
        return self._masks(self.names, self.size)

    @cached_property
    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        return self._masks(self._sorted, self.plain)

    def _masks(self, texts: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of each letter (by code modulo 64) as bits, and the letters (64: none); of texts that aren't too long."""
        codes, owner, at = self._spelt(texts, size)
        short = at < LETTERS
        codes, owner, at = codes[short] & 63, owner[short], at[short]
        where, letters = np.zeros((len(texts), 65), np.uint64), np.full((len(texts), at.max(initial=-1) + 1), 64, np.int8)
        np.bitwise_or.at(where, (owner, codes), np.uint64(1) << at.astype(np.uint64))
        letters[owner, at] = codes
        return where, letters


def _subsequences(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of texts that stand side by side, by bits; letters are compared by their code modulo 64."""
    where, letters = left[0][i], right[1][j]
    state, at = np.full(len(i), ~np.uint64(0)), np.arange(len(i))
    for y in letters.T:
        u = state & where[at, y]
        state = (state + u) | (state - u)
    return np.bitwise_count(~state).astype(np.int64)


def _windowed(short: _Letters, long: _Letters, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The partial ratios of texts with longer ones that stand side by side, or somewhat more, as letters are compared by their code modulo 64."""
    where, letters, n, m = short.plainly[0][i], long.plainly[1][j], short.size[i], long.size[j]
    most, at, out = int(n.max()), np.arange(len(i)), np.zeros(len(i))
    padded = np.full((letters.shape[1] + 2 * most, len(i)), 64, np.int8)
    padded[most : most + letters.shape[1]] = letters.T
    for start in range(1 - most, int(m.max())):
        state = np.full(len(i), ~np.uint64(0))
        for k in range(most):
            u = state & where[at, np.where(k < n, padded[most + start + k], 64)]
            state = (state + u) | (state - u)
        window = np.minimum(start + n, m) - max(0, start)
        out = np.maximum(out, np.where(window > 0, 2 * np.bitwise_count(~state).astype(np.int64) / np.maximum(n + window, 1), 0))
    return out


def _possible(a: _Letters, b: _Letters, shared: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of places can be that similar, by their common subsequences: these, of windows where there are many pairs, bound the ratios, and what Jaro's transpositions take off."""
    size_a, size_b = np.maximum(a.size[i], 1), np.maximum(b.size[j], 1)
    common, ends = _subsequences(a.plainly, b.plainly, i, j), np.minimum(size_a, size_b)
    most = 2 * common / (ends + common)
    some = np.flatnonzero((most + 0.15 * (a.one[i] | b.one[j]) >= least - 1e-9) & (np.maximum(size_a, size_b) <= LETTERS))
    if len(some) >= FEW:
        most[some] = 0
        for x, y, s, t in ((a, b, i, j), (b, a, j, i)):
            for part in np.array_split(some[x.size[s[some]] <= y.size[t[some]]], len(some) // WINDOWED + 1):
                if len(part):
                    most[part] = np.maximum(most[part], _windowed(x, y, s[part], t[part]))
    even = 2 * np.minimum(shared, np.minimum(a.plain[i], b.plain[j])) / np.maximum(a.plain[i] + b.plain[j], 1)
    some = np.flatnonzero(even + 0.15 * (a.one[i] | b.one[j]) >= least - 1e-9)
    most[some] = np.maximum(most[some], 2 * _subsequences(a.sorted, b.sorted, i[some], j[some]) / (a.plain[i[some]] + b.plain[j[some]]))
    same = np.cumprod((a.first[i] == b.first[j]) & (a.first[i] >= 0), axis=1).sum(1)
    # matched letters that stand in order are a common subsequence, so of m matched ones at least m - common don't
    jaro = np.zeros(len(i))
    for less in range(int((shared - common).max(initial=0)) + 1):
        m = np.maximum(np.minimum(shared, ends) - less, 1)
        jaro = np.maximum(jaro, (m / size_a + m / size_b + 1 - np.maximum(m - common, 0) // 2 / m) / 3)
    most = np.maximum(most, jaro + same * 0.1 * (1 - jaro)) + 0.15 * (a.one[i] | b.one[j])
    return (most >= least - 1e-9) | (np.maximum(size_a, size_b) > LETTERS)


def _close(left: list[str], right: list[str], least: float, within: bool = False, ordered: bool = False) -> Iterator[tuple[int, int, float]]:
    """Places and ``name_similarity`` of names of both sides that reach ``least`` (``within`` one list, each two once; ``ordered``: the smaller name is the first to compare). Only those are compared whose letters allow it: the letters that two names share bound all that the similarity is made of, and for those that are left so does what they have in common in order."""
    if not left or not right:
        return
    a = _Letters(left)
    b = a if right is left else _Letters(right)
    # a letter that a name has n times is n marks, so what two names share is a product
    marks = [(x, k) for x, n in enumerate(np.minimum(a.counts.max(0), b.counts.max(0))) for k in range(n)]
    letter, more = np.array(marks, int).reshape(-1, 2).T
    own = lambda s: (s.counts[:, letter] > more).astype(np.float32)
    shared = own(a) @ own(b).T
    bonus = 0.15 if a.one.any() or b.one.any() else 0.0
    goal = np.float32(least - bonus - 1e-4)
    of = lambda s, x: np.maximum(getattr(s, x), 1).astype(np.float32)
    size_a, size_b = of(a, "size")[:, None], of(b, "size")[None]
    # ratios: 2 * shared reaches the goal's share of both names, or of the shorter one and what it shares; Jaro: with four equal first letters
    hit = shared * (2 - goal) >= goal * np.minimum(size_a, size_b)
    hit |= 2 * shared >= goal * (of(a, "plain")[:, None] + of(b, "plain")[None])
    hit |= shared * (1 / size_a + 1 / size_b) >= 3 * (goal - np.float32(0.4)) / np.float32(0.6) - 1 - np.float32(1e-4)
    if within:
        hit = np.triu(hit, 1)
    rows, columns = np.nonzero(hit)
    for start in range(0, len(rows), AGAIN):
        i, j = rows[start : start + AGAIN], columns[start : start + AGAIN]
        some = _possible(a, b, shared[i, j].astype(np.int64), i, j, least)
        for x, y in zip(i[some].tolist(), j[some].tolist(), strict=True):
            p, q = left[x], right[y]
            score = name_similarity(q, p) if ordered and q < p else name_similarity(p, q)
            if score >= least:
                yield x, y, score


#: Side of a cell whose names are compared with each other.
_WITHIN = 2
_CELL = ("block", "low", "high", "side", "name", "id")


def _compared(batches: Iterator[pa.RecordBatch], least: float, ordered: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell; names of its one side are compared with other ones of the other side."""
    rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in _CELL), strict=True))
    out = []

    def done() -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["a", "b", "id_a", "id_b", "score"])

    for _, cell in itertools.groupby(rows, key=lambda r: r[:3]):
        sides: tuple[list, list, list] = ([], [], [])
        for r in cell:
            sides[r[3]].append(r[4:])
        within = bool(sides[_WITHIN])
        if within:
            sides = (sides[_WITHIN], sides[_WITHIN])
        if not sides[0] or not sides[1]:
            continue
        for i, j, score in _close([n for n, _ in sides[0]], [n for n, _ in sides[1]], least, within, ordered):
            (a, id_a), (b, id_b) = sides[0][i], sides[1][j]
            if a != b:
                out.append((a, b, id_a, id_b, score))
        if len(out) >= 10_000:
            yield done()
            out = []
    if out:
        yield done()


def _in_cells(dealt: DataFrame, least: float, ordered: bool = False) -> DataFrame:
    """``(a, b, id_a, id_b, score)`` of different names of both sides of a cell (``block``, ``low``, ``high``) that are at least that similar."""
    dealt = _spread(dealt.select(*_CELL), "block", "low", "high").sortWithinPartitions("block", "low", "high")
    return dealt.mapInArrow(lambda x: _compared(x, least, ordered), "a string, b string, id_a long, id_b long, score double")


def _within_blocks(spelt: DataFrame, least: float) -> DataFrame:
    """Pairs of different names of a block (``block``, ``name``, ``id``) that are at least that similar, each once; large blocks are dealt over a triangle of cells."""
    chunks = durable(spelt.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"), F.count("*").alias("_n")).where("_n > 1")).drop("_n")
    own = F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int")
    cell = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, own).alias("low"), F.greatest(c, own).alias("high")))
    dealt = spelt.join(chunks, "block").select("block", F.explode(cell).alias("cell"), "name", "id", own.alias("chunk"))
    dealt = dealt.select("block", "cell.*", "name", F.col("id").cast("long").alias("id"), "chunk")
    # a cell of two chunks compares across them; those within a chunk meet in its own cell
    side = F.when(F.col("low") == F.col("high"), _WITHIN).when(F.col("chunk") == F.col("low"), 0).otherwise(1)
    dealt = dealt.withColumn("side", side)
    found = _in_cells(dealt, least, ordered=True)
    turned = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return found.select(pick("a", "b").alias("name_a"), pick("b", "a").alias("name_b"), pick("id_a", "id_b").alias("id_a"), pick("id_b", "id_a").alias("id_b"), "score")


def _by_last_name(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Players (``id``, ``name``) with their last name as ``block``, and each name once with its least ``id`` and how many have it (``n``). Both are read several times."""
    own = durable(names.select("id", "name", last_name(F.col("name")).alias("block")).where(F.col("block") != ""))
    return own, durable(own.groupBy("block", "name").agg(F.min("id").alias("id"), F.count("*").alias("n")))


def duplicate_pairs(names: DataFrame, threshold: float = STRONG_MATCH) -> DataFrame:
    """``(id_a, id_b, score)`` of different players with the same last name whose names (``id``, ``name`` normalised) are that similar.

    Equal names are one row before they are compared, so a common name costs nothing; what is blocked together are different
    first names. A name's other players stand beside its least one only, and its least one beside those of similar names.
    """
    own, spelt = _by_last_name(names)
    close = _within_blocks(spelt, threshold)
    apart = close.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "score")
    first = Window.partitionBy("block", "name").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = own.withColumn("keep", F.min("id").over(first)).where(F.col("keep") != F.col("id")).select(F.col("keep").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("score"))
    return apart.unionByName(same)


def abbreviated_matches(incoming: DataFrame, players: DataFrame) -> DataFrame:
    """``(in_id, player_id)``: abbreviated names (``J. Pegula``) with full ones of the same last name and initial, and the other way round."""
    def keyed(df: DataFrame, key: str) -> DataFrame:
        name = F.col("name")
        first = F.regexp_replace(F.try_element_at(tokens(name), F.lit(1)), r"\.+$", "")
        return df.select(F.col("id").alias(key), is_abbreviated(name).alias(f"{key}_short"), first.alias(f"{key}_first"), F.concat_ws(" ", F.substring(first, 1, 1), last_name(name)).alias("block"), (F.size(tokens(name)) >= 2).alias(f"{key}_two"))

    pairs = keyed(incoming, "in_id").join(keyed(players, "player_id"), "block").where("in_id_two AND player_id_two")
    full = lambda k: ~F.col(f"{k}_short") & (F.length(f"{k}_first") >= 3)
    return pairs.where((F.col("in_id_short") & full("player_id")) | (F.col("player_id_short") & full("in_id"))).select("in_id", "player_id")


def _block_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``(a, b, score)``: names of ``left`` with other names of ``right`` (``name``, ``block``) in the same block that are at least that similar; large blocks are dealt over a grid of cells."""
    sizes = [df.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n), F.min("name").alias(f"{n}_min"), F.max("name").alias(f"{n}_max")) for df, n in ((left, "_l"), (right, "_r"))]
    lone = (F.col("_l_min") == F.col("_l_max")) & (F.col("_r_min") == F.col("_r_max")) & (F.col("_l_min") == F.col("_r_min"))
    grid = durable(sizes[0].join(sizes[1], "block").where(~lone).select("block", "_l", "_r"))

    def dealt(df: DataFrame, own: str, other: str, side: int) -> DataFrame:
        rows = df.join(grid, "block").withColumn(own, F.pmod(F.xxhash64("name"), F.col(own)).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return rows.select("block", F.col("_l").alias("low"), F.col("_r").alias("high"), F.lit(side).alias("side"), "name", F.lit(None).cast("long").alias("id"))

    return _in_cells(dealt(left, "_l", "_r", 0).unionByName(dealt(right, "_r", "_l", 1)), least).select("a", "b", "score")


@sealed
def similar_names(asked: DataFrame, known: DataFrame, least: float = STRONG_MATCH) -> DataFrame:
    """``(a, b, trigram, score, short)``: how names of ``asked`` and other ones of ``known`` (``name``, each once) resemble each other.

    ``trigram`` is their trigram similarity from ``least`` on, ``score`` that of names with the same last name, ``short`` tells that one abbreviates the other
    (``j. pegula``; the full first name has three letters or more).
    """
    # names go by a hash while they are dealt by keys; they come back for the comparison
    number = lambda df: df.select(F.xxhash64("name").alias("id"), "name")
    near = _trigram_named(number(asked), number(known), least, others=True).where("left_name <> right_name").select(F.col("left_name").alias("a"), F.col("right_name").alias("b"), F.col("similarity").alias("trigram"))
    blocked = lambda df: df.select("name", last_name(F.col("name")).alias("block")).where("block <> ''")
    alike = _block_pairs(blocked(asked), blocked(known), least)

    def keyed(df: DataFrame, side: str) -> DataFrame:
        name, first = F.col("name"), first_name(F.col("name"))
        two = df.where(F.size(tokens(name)) >= 2)
        return two.select(name.alias(side), is_abbreviated(name).alias(f"{side}_short"), first.alias(f"{side}_first"), F.struct(F.substring(first, 1, 1), last_name(name)).alias("block"))

    plain = lambda s: F.col(s).rlike(r"^\S\.? \S") & (F.regexp_replace(s, r"^\S\.? ", "") == F.col("block.col2"))
    ends = F.endswith(F.col("b"), F.concat(F.lit(" "), F.col("block.col2"))) & (F.length("b_first") >= 3)
    # one of both is short
    pairs = keyed(asked, "a").join(keyed(known, "b").withColumn("a_short", ~F.col("b_short")), ["block", "a_short"])
    short = pairs.where((F.col("a_short") & ~F.col("b_short") & ends) | (~F.col("a_short") & F.col("b_short") & plain("b"))).select("a", "b", compare_names("a", "b").alias("score"), F.lit(True).alias("short"))
    every = near.unionByName(alike, allowMissingColumns=True).unionByName(short, allowMissingColumns=True)
    return every.groupBy("a", "b").agg(F.max("trigram").alias("trigram"), F.max("score").alias("score"), F.coalesce(F.bool_or("short"), F.lit(False)).alias("short"))


#: Kinds of rows of a component, in the order in which they are read.
_PLAYER, _ALIAS, _PAIR, _RECORD = range(4)


class _Cascade:
    """The players that records can meet, and what a record makes of them."""

    def __init__(self, people: list, aliases: list, pairs: list):
        self.gender, self.ids, self.has = {}, {}, set()
        for player, gender, source, external in people:
            self.gender[player] = gender
            if external is not None:
                self.ids[source, external] = player
                self.has.add((player, source))
        self.owners: dict[str, list] = {}
        for alias, player in sorted(aliases):
            self.owners.setdefault(alias, []).append(player)
        self.near: dict[str, list] = {}
        for a, *rest in pairs:
            self.near.setdefault(a, []).append(rest)

    def fits(self, player: object, expected: str | None) -> bool:
        own = self.gender.get(player)
        return expected is None or own is None or own == expected

    def learn(self, player: object, name: str, source: str | None = None, external: str | None = None) -> None:
        owners = self.owners.setdefault(name, [])
        if player not in owners:
            owners.append(player)
        if source and external and (player, source) not in self.has:
            self.ids[source, external] = player
            self.has.add((player, source))
            self.linked = True

    def best(self, scored: list) -> dict:
        """The best score of each player who has one of the names."""
        found: dict = {}
        for name, score in scored:
            for player in self.owners.get(name, ()):
                found[player] = max(score, found.get(player, 0.0))
        return found

    def resolve(self, record: object, name: str, source: str | None, external: str | None, expected: str | None) -> tuple[object, str]:
        self.linked = False
        known = self.ids.get((source, external)) if external else None
        if known is not None:
            self.learn(known, name)
            return known, "matched"
        owner = self.owners.get(name, [None])[0]
        if owner is not None and self.fits(owner, expected):
            return owner, "matched"
        near = self.near.get(name, [])
        short = {p: s for p, s in self.best([(b, score) for b, _, score, short in near if short]).items() if self.fits(p, expected)}
        if len(short) == 1:
            (player,) = short
            self.learn(player, name, source, external)
            return player, "matched"
        if sum(s >= STRONG_MATCH for s in short.values()) > 1:
            return None, "queued"
        close = self.best([(name, 1.0)] * bool(name) + [(b, t) for b, t, _, _ in near if t is not None])
        if max(close.values(), default=0.0) < AUTO_MATCH:
            for player, score in self.best([(b, s) for b, _, s, _ in near if s is not None and s >= STRONG_MATCH]).items():
                close[player] = max(score, close.get(player, 0.0))
        top = sorted(close.items(), key=lambda c: (-c[1], str(type(c[0])), c[0]))[:5]
        strong = [(p, s) for p, s in top if self.fits(p, expected)]
        if strong and strong[0][1] >= AUTO_MATCH:
            self.learn(strong[0][0], name, source, external)
            return strong[0][0], "matched"
        if len(strong) > 1:
            return None, "queued"
        made = ("made", record)
        self.learn(made, name, source, external)
        return made, "created"


_FACTS = ("component", "kind", "run", "id", "name", "other", "source", "external", "gender", "trigram", "score", "short")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component, those of players, aliases and pairs before its records in their order."""
    rows = (dict(zip(_FACTS, r, strict=True)) for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in _FACTS), strict=True))
    names, out = ("component", "run", "player_id", "made_by", "status", "linked"), []

    def done() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for component, group in itertools.groupby(rows, key=lambda r: r["component"]):
        people, aliases, pairs, cascade = [], [], [], None
        for r in group:
            if r["kind"] == _PLAYER:
                people.append((r["id"], r["gender"], r["source"], r["external"]))
            elif r["kind"] == _ALIAS:
                aliases.append((r["name"], r["id"]))
            elif r["kind"] == _PAIR:
                pairs.append((r["name"], r["other"], r["trigram"], r["score"], r["short"]))
            else:
                cascade = cascade or _Cascade(people, aliases, pairs)
                player, status = cascade.resolve(r["id"], r["name"], r["source"], r["external"], r["gender"])
                made = player[1] if isinstance(player, tuple) else None
                out.append((component, r["run"], None if made is not None else player, made, status, cascade.linked))
        if len(out) >= 10_000:
            yield done()
            out = []
    if out:
        yield done()


@sealed
def resolve(incoming: DataFrame, players: DataFrame, aliases: DataFrame, genders: DataFrame | None = None) -> DataFrame:
    """``(in_id, player_id, made_by, status, linked)`` of incoming names by a cascade, record by record in the order of their ids, each seeing what those before it have led to.

    ``incoming`` has ``id``, ``name`` (normalised), ``source_key``, ``external_id`` and ``gender`` (expected, or null); ``players`` has ``id``, ``name`` and an external id
    for each source (``atp_id``, ``wta_id``); ``aliases`` has ``alias`` and ``player_id``. A player's own name is an alias. Stages: external id; alias; abbreviation (one
    candidate matches, several with 0.95 and more queue); similar names of aliases (the best with 0.98 and more matches, several with 0.95 and more queue); else
    a player is created. But for the first stage, a player of another gender is no candidate; players without one are. ``made_by`` is the record that created the player, whose id
    is a hash of it, ``linked`` tells that the player has got the record's external id. A match by external id teaches the player the name, one by similarity also the external id, if there is none of that source.

    Only records that share a player, a name, an external id or similar names can depend on each other. These are components of a graph of names, ids and players;
    the records of a component are folded in one task one after another, equal ones in a row as one. Nodes are 64-bit hashes; where two are equal, two
    components are folded as one, to the same result.
    """
    # each is read several times
    players, aliases = (durable(df) for df in (players.select("id", "name", *[c for c in players.columns if c.endswith("_id")]), aliases.select("alias", "player_id")))
    key = ["name", "source_key", "external_id", "gender"]
    rows = durable(incoming.select("id", F.coalesce("name", F.lit("")).alias("name"), "source_key", F.nullif("external_id", F.lit("")).alias("external_id"), "gender"))
    sources = [c for c in players.columns if c.endswith("_id")]
    asked = durable(rows.select("name").distinct())
    known = players.select(F.coalesce("name", F.lit("")).alias("name"), "id").unionByName(aliases.select(F.col("alias").alias("name"), F.col("player_id").alias("id"))).where("name <> ''").distinct()
    pairs = similar_names(asked, known.select("name").unionByName(asked).distinct())
    near = asked.unionByName(pairs.select(F.col("b").alias("name"))).distinct()
    owned = known.join(near, "name", "left_semi")
    ids = players.select("id", F.explode(F.array(*[F.struct(F.lit(c.removesuffix("_id")).alias("source"), F.col(c).alias("external")) for c in sources])).alias("x")).select("id", "x.*").where("external IS NOT NULL")
    wanted = rows.where("external_id IS NOT NULL").select(F.col("source_key").alias("source"), F.col("external_id").alias("external")).distinct()
    there = durable(owned.select("id").unionByName(ids.join(wanted, ["source", "external"], "left_semi").select("id")).distinct())
    people = there.join(ids, "id", "left")
    gender = genders.select(F.col("player_id").alias("id"), "gender") if genders is not None else there.select("id", F.lit(None).cast("string").alias("gender")).limit(0)
    people = people.join(gender, "id", "left")

    node = lambda kind, *columns: F.xxhash64(F.lit(kind), *[c.cast("string") for c in columns])
    name_node, id_node = node("n", F.col("name")), node("x", F.col("source"), F.col("external"))
    links = [
        pairs.select(node("n", F.col("a")).alias("a"), node("n", F.col("b")).alias("b")), owned.select(node("p", F.col("id")).alias("a"), name_node.alias("b")), people.where("external IS NOT NULL").select(node("p", F.col("id")).alias("a"), id_node.alias("b")),
        rows.where("external_id IS NOT NULL").select(name_node.alias("a"), node("x", F.col("source_key"), F.col("external_id")).alias("b")).distinct(),
    ]
    found = durable(connected_components(reduce(DataFrame.unionByName, links)))

    def placed(df: DataFrame, own: Column) -> DataFrame:
        return df.withColumn("node", own).join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")

    # equal records in a row have one outcome, but for the first that creates
    order = Window.partitionBy("component").orderBy("id")
    told = F.struct(*key)
    runs = placed(rows, name_node).withColumn("head", F.row_number().over(order) == 1).withColumn("head", F.col("head") | ~F.lag(told).over(order).eqNullSafe(told))
    runs = durable(runs.withColumn("run", F.sum(F.col("head").cast("long")).over(order)))
    kinds = [
        placed(people, node("p", F.col("id"))).select("component", F.lit(_PLAYER).alias("kind"), "id", "gender", "source", "external"),
        placed(owned, name_node).select("component", F.lit(_ALIAS).alias("kind"), "id", "name"),
        placed(pairs.withColumnRenamed("a", "name"), name_node).select("component", F.lit(_PAIR).alias("kind"), "name", F.col("b").alias("other"), "trigram", "score", "short"),
        runs.where("head").select("component", F.lit(_RECORD).alias("kind"), "run", "id", "name", F.col("source_key").alias("source"), F.col("external_id").alias("external"), "gender"),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds).select(*_FACTS)
    every = every.join(runs.select("component").distinct(), "component", "left_semi")
    # by a hash of its own: Spark leaves out a shuffle by a column by which all parts of a union are dealt already, and adaptive execution then joins the partitions of each part in another way
    every = every.repartition(F.xxhash64("component")).sortWithinPartitions("component", "kind", "run")
    done = every.mapInArrow(_fold, "component long, run long, player_id long, made_by long, status string, linked boolean")
    status = F.when(~F.col("head") & (F.col("status") == "created"), "matched").otherwise(F.col("status"))
    player = F.coalesce("player_id", F.when(F.col("made_by").isNotNull(), F.xxhash64(F.lit("player"), "made_by")))
    return runs.join(done, ["component", "run"]).select(F.col("id").alias("in_id"), player.alias("player_id"), "made_by", status.alias("status"), (F.col("head") & F.col("linked")).alias("linked"))


def learned(incoming: DataFrame, resolved: DataFrame, players: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Players and aliases after ``resolve()``: those created, the external ids that players have got, and the names under which they have been found."""
    rows = durable(incoming.join(resolved.withColumnRenamed("in_id", "id"), "id").where(F.col("player_id").isNotNull()))
    sources = [c for c in players.columns if c.endswith("_id")]
    given = rows.where("linked").groupBy(F.col("player_id").alias("id")).agg(*[F.min(F.when(F.col("source_key") == c.removesuffix("_id"), F.col("external_id"))).alias(c) for c in sources])
    made = rows.where("status = 'created'").select(F.col("player_id").alias("id"), "name")
    every = players.unionByName(made, allowMissingColumns=True)
    return fill_null(every, given, "id", sources), ensure_aliases(aliases, rows.where("name <> ''").select("player_id", F.col("name").alias("alias"), F.col("source_key").alias("source")))


def suggestions(names: DataFrame, threshold: float = STRONG_MATCH, keep: int = 3, least: int = 2) -> DataFrame:
    """Review queue: players (``id``, ``name`` normalised) with at least ``least`` others of the same last name whose names are that similar, how many these are (``candidates``), and the best ``keep``.

    Every other player counts, those of an equal name too. But all players of a name have the same others, themselves left out: names are compared and counted, and players
    never become pairs. Among the first ``keep`` + 1 of all who have a name or one like it are each one's best ``keep``.
    """
    own, spelt = _by_last_name(names.select("id", "name").distinct())
    close = durable(_within_blocks(spelt, threshold).select("name_a", "name_b", "score"))
    both = close.toDF("name", "other", "score").unionByName(close.toDF("other", "name", "score"))
    more = both.join(spelt.select(F.col("name").alias("other"), F.col("n").alias("more")), "other").select("name", "more")
    counts = spelt.select("name", (F.col("n") - 1).alias("more")).unionByName(more).groupBy("name").agg(F.sum("more").alias("candidates")).where(F.col("candidates") >= least)
    first = durable(own.withColumn("at", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where(F.col("at") <= keep + 1).select("name", F.col("id").alias("player_id")))
    others = both.join(first.withColumnRenamed("name", "other"), "other").select("name", "player_id", "score")
    order = Window.partitionBy("name").orderBy(F.col("score").desc(), "player_id")
    best = first.withColumn("score", F.lit(1.0)).unionByName(others).withColumn("at", F.row_number().over(order)).where(F.col("at") <= keep + 1)
    best = best.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "player_id", "score"))).alias("best"))
    rows = own.select("id", "name").join(counts.join(best, "name"), "name")
    suggested = F.slice(F.filter("best", lambda s: s["player_id"] != F.col("id")), 1, keep)
    return rows.select("id", F.transform(suggested, lambda s: F.struct(s["player_id"].alias("player_id"), F.round(s["score"], 4).alias("confidence"))).alias("suggested"), "candidates")


def keep_choice(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """``(keep_id, merge_id)`` of each pair: the one with more matches, then more external ids, then the smaller id stays.

    ``weights`` has ``id``, ``matches`` and ``external_ids``.
    """
    w = lambda s: weights.select(F.col("id").alias(f"id_{s}"), F.struct("matches", "external_ids", (-F.col("id")).alias("low")).alias(f"w_{s}"))
    rows = pairs.join(w("a"), "id_a").join(w("b"), "id_b")
    first = F.col("w_a") >= F.col("w_b")
    return rows.select(F.when(first, F.col("id_a")).otherwise(F.col("id_b")).alias("keep_id"), F.when(first, F.col("id_b")).otherwise(F.col("id_a")).alias("merge_id"))


def merge_targets(redirects: DataFrame) -> DataFrame:
    """``(from_id, to_id)``: where chains of ``(merge_id, keep_id)`` end, by doubling the length of the known steps.

    Of several targets of an id the least holds. An id on a circle goes to the circle's least id.
    """
    step = redirects.groupBy(F.col("merge_id").alias("from_id")).agg(F.min("keep_id").alias("to_id"))
    count = step.count()
    reached = step.withColumn("least", F.least("from_id", "to_id"))
    doubled = 1
    while doubled < count:
        on = reached.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("_next"), F.col("least").alias("_least"))
        ahead = reached.join(on, "to_id", "left")
        moved = ahead.select("from_id", F.coalesce("_next", "to_id").alias("to_id"), F.least("least", F.coalesce("_least", "least"), F.coalesce("_next", "to_id")).alias("least"), F.col("_next").isNotNull().alias("moved"))
        moved = durable(moved)
        reached = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
        doubled *= 2
    circles = reached.join(step.select(F.col("from_id").alias("to_id"), F.lit(True).alias("_circle")), "to_id", "left")
    return circles.select("from_id", F.when(F.col("_circle"), F.col("least")).otherwise(F.col("to_id")).alias("to_id")).where(F.col("from_id") != F.col("to_id"))


def merge_players(redirects: DataFrame, matches: DataFrame, aliases: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches, aliases and states after all merges: ids remapped, repeated aliases dropped, merged players' states gone.

    If matches have ``elo_needs_recompute``, it is set for all of the players who stay.
    """
    to = durable(merge_targets(redirects))
    matches = remap(matches, to, ["player_a_id", "player_b_id", "winner_id"])
    if "elo_needs_recompute" in matches.columns:
        matches = _to_recompute(matches, to.select(F.col("to_id").alias("player_id")))
    aliases = remap(aliases, to, ["player_id"])
    aliases = first_by(aliases, ["alias", "source"], [F.col("player_id")])
    return matches, aliases, states.join(to.select(F.col("from_id").alias("player_id")), "player_id", "left_anti")


def _to_recompute(matches: DataFrame, players: DataFrame) -> DataFrame:
    """``matches`` with ``elo_needs_recompute`` set for those of ``players`` (``player_id``)."""
    hit = sides(matches, "id").join(players.distinct(), "player_id", "left_semi").select("id", F.lit(True).alias("_hit")).distinct()
    rows = matches.join(hit, "id", "left").withColumn("elo_needs_recompute", F.coalesce("_hit", "elo_needs_recompute"))
    return rows.select(*matches.columns)


def merge_profiles(redirects: DataFrame, players: DataFrame, columns: tuple[str, ...] = ("atp_id", "wta_id")) -> tuple[DataFrame, DataFrame]:
    """Players after all merges, and the audit records (``keep_id``, ``merge_id``, ``merged_name``).

    A player that stays takes the external ids it lacks (of several merged players, the one with the smallest id gives), and the full name that its own
    one abbreviates if they are similar; ``needs_recompute`` is set, since its matches have changed.
    """
    to = durable(merge_targets(redirects))
    gone = players.join(to, players["id"] == to["from_id"])
    audit = gone.select(F.col("to_id").alias("keep_id"), F.col("from_id").alias("merge_id"), F.col("name").alias("merged_name"))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("from_id"))).alias(c)
    given = gone.groupBy(F.col("to_id").alias("id")).agg(*[first(c) for c in columns])
    kept = players.join(to.select(F.col("from_id").alias("id")), "id", "left_anti")
    names = audit.join(kept.select(F.col("id").alias("keep_id"), "name"), "keep_id").where(fuller(F.col("name"), F.col("merged_name")))
    names = names.where(compare_names("name", "merged_name") >= LIKELY_MATCH)
    names = names.groupBy(F.col("keep_id").alias("id")).agg(F.max_by("merged_name", F.struct(F.length("merged_name"), "merged_name")).alias("name"))
    kept = fill_null(fill_null(kept, given, "id", columns), names, "id", ["name"], overwrite=True)
    touched = given.select("id", F.lit(True).alias("_hit"))
    return kept.join(touched, "id", "left").select(*players.columns, F.coalesce("_hit", F.lit(False)).alias("needs_recompute")), audit


def merge_queue(redirects: DataFrame, queue: DataFrame) -> DataFrame:
    """The review queue with merged players replaced, as resolved and as suggested ones; a player is suggested once."""
    to = durable(merge_targets(redirects))
    out = remap(queue, to, ["resolved_player_id"])
    each = queue.select("id", F.posexplode("suggested").alias("at", "player_id"))
    each = remap(each, to, ["player_id"]).groupBy("id", "player_id").agg(F.min("at").alias("at"))
    lists = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "player_id"))), lambda x: x["player_id"]).alias("_suggested"))
    return out.join(lists, "id", "left").withColumn("suggested", F.coalesce("_suggested", "suggested")).select(*queue.columns)


def resolve_review(queue: DataFrame, decisions: DataFrame, players: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next versions of queue, players and aliases after ``decisions`` (``id``, ``action``, ``player_id``).

    ``match`` links name and external id to a player, ``create`` makes one (its id is a hash of name and source), ``ignore`` only closes the item. Other
    actions, and a match without a player, change nothing. ``queue`` has ``id``, ``name``, ``source``, ``external_id``, ``status``, ``resolved_player_id``.
    """
    action = F.col("action")
    valid = action.isin("create", "ignore") | ((action == "match") & F.col("_to").isNotNull())
    taken = queue.join(first_by(decisions, ["id"], [F.col("action"), F.col("player_id")]).select("id", "action", F.col("player_id").alias("_to")), "id").where(valid)
    target = F.when(action == "match", F.col("_to")).when(action == "create", F.xxhash64("name", "source"))
    taken = durable(taken.withColumn("_player", target))
    status = F.when(action == "match", "matched").when(action == "create", "new_player").otherwise("ignored")
    change = taken.select("id", F.struct(status.alias("status"), F.col("_player").alias("player")).alias("_new"))
    rows = queue.join(change, "id", "left")
    new = {"status": F.coalesce("_new.status", "status"), "resolved_player_id": F.coalesce("_new.player", "resolved_player_id")}
    queue = rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in queue.columns])
    own = {f"{s}_id": F.min(F.when(F.col("source") == s, F.col("external_id"))).alias(f"{s}_id") for s in ("atp", "wta") if f"{s}_id" in players.columns}
    links = taken.where(F.col("_player").isNotNull()).groupBy(F.col("_player").alias("id")).agg(F.min("name").alias("name"), F.max(action == "create").alias("_new"), *own.values())
    made = links.where("_new").drop("_new").join(players.select("id"), "id", "left_anti")
    players = fill_null(players, links, "id", list(own)).unionByName(made, allowMissingColumns=True)
    known = taken.where(F.col("_player").isNotNull()).select(F.col("_player").alias("player_id"), F.col("name").alias("alias"), "source")
    return queue, players, ensure_aliases(aliases, known)


def link_ids(players: DataFrame, found: DataFrame, columns: tuple[str, ...] = ("atp_id", "wta_id")) -> DataFrame:
    """``players`` with external ids of other tours (``id`` and ``columns``, any number of rows a player) where they have none yet."""
    return fill_null(players, found.groupBy("id").agg(*[F.min(c).alias(c) for c in columns]), "id", columns)


def full_names_of_others(players: DataFrame, threshold: float = LIKELY_MATCH) -> DataFrame:
    """``(id, name)``: for abbreviated names the full one of another player, if there is exactly one that fits."""
    keyed = players.select("id", "name", F.concat_ws(" ", F.substring("name", 1, 1), last_name(F.col("name"))).alias("block"))
    others = keyed.where(~is_abbreviated(F.col("name"))).select("block", F.col("id").alias("other"), F.col("name").alias("full"))
    pairs = keyed.where(is_abbreviated(F.col("name"))).join(others, "block").where((F.col("id") != F.col("other")) & fuller(F.col("name"), F.col("full")))
    pairs = pairs.where(compare_names("name", "full") >= threshold)
    return pairs.groupBy("id").agg(F.count("*").alias("n"), F.min("full").alias("name")).where("n = 1").select("id", "name")


def ensure_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """``aliases`` with the new ones that no player has yet for that source."""
    return insert_missing(aliases, new.select(*aliases.columns), ["alias", "source"])


def infer_gender(counts: DataFrame) -> DataFrame:
    """``(player_id, gender)`` from ``gender_counts()``: mixed for a tie, null without matches."""
    gender = F.when((F.col("men") == 0) & (F.col("women") == 0), None).when(F.col("men") > F.col("women"), "men").when(F.col("women") > F.col("men"), "women").otherwise("mixed")
    return counts.select("player_id", gender.alias("gender"))


def same_gender(expected: Column, inferred: Column) -> Column:
    return expected.isNull() | inferred.isNull() | (expected == inferred)


def split_mixed(star: DataFrame, counts: DataFrame) -> DataFrame:
    """``(id, side, player_id, new_gender)``: sides of matches to give to a new player, since they are of the gender that the player has less of (of women, if equal)."""
    both = counts.where((F.col("men") > 0) & (F.col("women") > 0)).select("player_id", F.when(F.col("men") >= F.col("women"), "women").otherwise("men").alias("new_gender"))
    return sides(star, "id", "t_gender").join(both, "player_id").where(F.col("t_gender") == F.col("new_gender")).select("id", "side", "player_id", "new_gender")


def apply_split(star: DataFrame, counts: DataFrame, matches: DataFrame, players: DataFrame, aliases: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Matches, players, aliases and states after ``split_mixed()``: a new player takes the other gender's sides.

    The new one's id is a hash of the old one's; the name is the initial and the last name, its normalised form is an alias, and what is known of the person is copied, but
    no external id. Both players' states go, and their matches are flagged, if matches have ``elo_needs_recompute``.
    """
    moved = durable(split_mixed(star, counts).withColumn("new_id", F.xxhash64(F.lit("split"), "player_id")))
    out = matches
    for side in "ab":
        own = moved.where(F.col("side") == side.upper()).select("id", F.col("player_id").alias("_old"), F.col("new_id").alias("_new"))
        rows = out.join(own, "id", "left").withColumn(f"player_{side}_id", F.coalesce("_new", f"player_{side}_id"))
        out = rows.withColumn("winner_id", F.when(F.col("winner_id") == F.col("_old"), F.col("_new")).otherwise(F.col("winner_id"))).select(*matches.columns)
    who = durable(moved.select("player_id", "new_id", "new_gender").distinct())
    name = F.lower(F.col("name"))
    short = F.concat(F.upper(F.substring(name, 1, 1)), F.lit(". "), F.initcap(last_name(name)))
    ids = [c for c in ("atp_id", "wta_id", "itf_id") if c in players.columns]
    made = players.join(who, players["id"] == who["player_id"]).withColumns({"id": F.col("new_id"), "name": short} | {c: F.lit(None).cast("string") for c in ids})
    new_aliases = made.select(F.col("id").alias("player_id"), F.lower("name").alias("alias"), F.concat(F.lit("split_"), "new_gender", F.lit("_"), "id").alias("source"))
    both = who.select("player_id").unionByName(who.select(F.col("new_id").alias("player_id")))
    if "elo_needs_recompute" in out.columns:
        out = _to_recompute(out, both)
    return out, players.unionByName(made.select(*players.columns)), aliases.unionByName(new_aliases.select(*aliases.columns)), states.join(both, "player_id", "left_anti")


def full_aliases(players: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(id, name)``: for players with an abbreviated name the full alias that it abbreviates, the one with the longest first word, then the longest."""
    rows = players.select("id", "name").join(aliases.select(F.col("player_id").alias("id"), "alias"), "id").where(fuller(F.col("name"), F.col("alias")))
    return rows.groupBy("id").agg(F.max_by("alias", F.struct(F.length(first_name(F.col("alias"))), F.length("alias"), "alias")).alias("name"))


def repaired_names(players: DataFrame, aliases: DataFrame, threshold: float = STRONG_MATCH) -> DataFrame:
    """``players`` (``name`` normalised) whose abbreviated names have been made full: by an alias of their own, else by the one other player's name that fits."""
    own = durable(full_aliases(players, aliases))
    others = full_names_of_others(players, threshold).join(own.select("id"), "id", "left_anti")
    return fill_null(players, own.unionByName(others), "id", ["name"], overwrite=True)


def repaired_winners(matches: DataFrame, parsed_winner: Column) -> DataFrame:
    """``(id, winner_id)`` of matches whose winner isn't the one that the score tells of."""
    told = F.when(parsed_winner == "A", F.col("player_a_id")).when(parsed_winner == "B", F.col("player_b_id"))
    rows = matches.where(F.col("winner_id").isNotNull() & F.col("score").isNotNull() & ~F.col("score").isin("", "W/O"))
    return rows.where(told.isNotNull() & (told != F.col("winner_id"))).select("id", told.alias("winner_id"))


def recovered_aliases(log: DataFrame, aliases: DataFrame, players: DataFrame) -> DataFrame:
    """Aliases that merges have lost: from audit records (``details`` JSON with ``keep_id`` and ``merged_name``), if similar to the name that stayed."""
    rows = log.select(F.get_json_object("details", "$.keep_id").try_cast("long").alias("player_id"), F.get_json_object("details", "$.merged_name").alias("alias")).where("player_id IS NOT NULL AND alias IS NOT NULL").distinct()
    rows = rows.join(players.select(F.col("id").alias("player_id"), "name"), "player_id").withColumn("score", compare_names("alias", "name")).where(F.col("score") >= LIKELY_MATCH)
    return rows.join(aliases.select("player_id", "alias"), ["player_id", "alias"], "left_anti").select("player_id", "alias")


def best_alias(aliases: DataFrame) -> DataFrame:
    """``(player_id, name)``: the full (not abbreviated) alias with the longest first word, then the longest."""
    first = F.try_element_at(tokens(F.col("alias")), F.lit(1))
    full = aliases.where(~is_abbreviated(F.col("alias")) & (F.size(tokens(F.col("alias"))) >= 2))
    return full.groupBy("player_id").agg(F.max_by("alias", F.struct(F.length(first), F.length("alias"), "alias")).alias("name"))


def variants(names: DataFrame) -> DataFrame:
    """``(id, variant)`` for search."""
    return names.select("id", F.explode(search_variants(F.col("name"))).alias("variant"))


def empty_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "player_id long, alias string, source string")
