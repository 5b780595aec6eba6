import hashlib
import random
import re
import zlib
from fractions import Fraction

from topspin.llm import periodic_runs, queries


def brute(words):
    """Every period of every stretch, from the definition."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(6, 4 * q):
                part = words[start : start + length]
                if min(p for p in range(1, q + 1) if part[p:] == part[:-p]) == q:
                    found.append((start, length, q))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def mixed(rng, size, letters, longest):
    words = []
    while len(words) < size:
        root = rng.choices(letters, k=rng.randint(1, longest))
        words += (root * 8)[: rng.randint(1, 7 * len(root))] if rng.random() < 0.4 else root
    return words


def test_runs_equal_those_of_the_definition():
    rng, longer = random.Random(3), 0
    for _ in range(800):
        words = mixed(rng, rng.randint(0, 250), "abcdefgh"[: rng.choice([1, 2, 3, 8])], rng.choice([2, 8, 40]))
        found = brute(words)
        assert periodic_runs.find_runs(words) == found
        longer += sum(q > periodic_runs.SHORT for _, _, q in found)
    assert longer > 100


def test_long_texts():
    assert periodic_runs.find_runs(["a"] * 300_000) == [(0, 300_000, 1)]
    root = [str(i) for i in range(20_000)]
    assert periodic_runs.find_runs([*"xyz", *root * 4, *root[:7]]) == [(3, 80_007, 20_000)]


def test_collapse_drops_what_follows_a_first_period():
    words = "x a b a b a b a b a y z z z z z z".split()
    runs = periodic_runs.find_runs(words)
    assert runs == [(1, 9, 2), (11, 6, 1)]
    assert periodic_runs.collapse(words, runs) == "x a b y z".split()


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    given = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *given, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_equals_brute_force_with_nulls_ties_repeats_and_clashing_columns(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "one", "a b c\x85d " * 3, "Ж ж\x1cz " * 9, "a a a a a a b b b b b b", "a b " * 5 + "c d " * 5, "x " * 3000]
    texts += [" ".join(mixed(rng, rng.randint(1, 150), ["a", "b", "ç", "d"], 12)) for _ in range(150)]
    rows = [(i, t, 7, "n") for i, t in enumerate(texts)] + [(3, "one", 7, "n"), (None, "q " * 8, 7, "n")]
    spark.createDataFrame(rows, "doc_id long, text string, n_runs int, runs string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(expected(r[0], r[1])) for r in rows)


def test_empty_table(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
