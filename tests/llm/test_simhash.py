import random

import pytest

from topspin.llm import simhash
from topspin.operators.graph import connected_components


def brute(texts):
    fps = [simhash.fingerprint(t) for t in texts]
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return [(i, f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, comp, strict=True))]


def plain_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgé", k=4)) for _ in range(300)]
    texts = [None, "", " \t\n", "One", "one", "two Words", "x\x1cy z w", "long " * 40_000]
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(3, 200))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            base = base[:]
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
    return texts


def test_matches_brute_force_with_ties_nulls_and_extra_columns(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 1, "f") for i, t in enumerate(texts)], "doc_id long, text string, component_id int, fingerprint string")
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs).collect())
    assert got == brute(texts)
    assert [int(f, 16) for _, f, _ in got] == [plain_fingerprint(t or "") for t in texts]


@pytest.mark.parametrize("tile", [4, 16])
def test_large_bands_are_cut_into_cells(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "SUBTILE", 8)
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 300:
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << rng.randrange(64) for _ in range(3)) if rng.random() < 0.9 else rng.getrandbits(64))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fingerprint long")
    links = simhash.near_links(df).collect()
    group = {f: f for f in fps}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for r in links:
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        group[root(a)] = root(b)
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                assert root(a) == root(b)
    plain = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            plain[a] = min(plain[b] for b in fps if (a ^ b).bit_count() <= 3)
    assert len({root(f) for f in fps}) == len(set(plain.values()))


def test_null_ids_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, "quite other words here")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert simhash.near_duplicates(docs).count() == 4
    assert got == {(7, 7), (None, 7), (None, None)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 530)] + [(9, 9), (3, 1), (1, 3), (None, 2)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 100) for i in range(100, 161)} | {(i, 500) for i in range(500, 530)} | {(1, 1), (3, 1)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
