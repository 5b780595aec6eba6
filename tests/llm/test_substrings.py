import itertools
import random
import re

import numpy as np
import pytest

from topspin.llm import substrings
from topspin.operators.graph import connected_components
from topspin.llm.substrings import LEAST_WORDS, RECALL, SHINGLE, SIMILARITY, Passages, alike_links, bands_for, cut, repeated_passages, repeats, spans, without_repeats


def words(text):
    return re.findall(r"\S+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def lines(text):
    return [w for w in map(words, (text or "").split("\n")) if len(w) >= LEAST_WORDS]


def shingles(w):
    return {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def vocabulary(rng, n=4000):
    return ["".join(rng.choices("abcdefghé", k=rng.randint(2, 7))) for _ in range(n)]


def make(seed=1):
    rng = random.Random(seed)
    known = vocabulary(rng)
    text = lambda n: " ".join(rng.choices(known, k=n))
    passages = [text(56) for _ in range(8)]
    docs = {i: "\n".join(text(rng.randint(3, 90)) for _ in range(4)) for i in range(60)}
    for i in range(60, 90):
        docs[i] = f"{text(rng.randint(0, 80))} {passages[i % 8]} {text(rng.randint(5, 80))}".strip()
    docs[90] = docs[5]
    for i in range(91, 131):
        changed = [w.split(" ") for w in docs[rng.randrange(60)].split("\n")]
        for w in changed:
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = "changed"
        docs[i] = f"{text(20)}\n" + "\n".join(map(" ".join, changed))
    docs |= {131: None, 132: "", 133: "two words", 134: "echo " * 40_000, 135: f"{passages[0]}\n{passages[0]}"}
    return docs, passages


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 7) for d, t in docs.items()], "doc_id long, text string, hash string, n_chars long")


def paragraph_components(docs):
    """All pairs of paragraphs, whatever document they are from: the smallest (document, place) that each reaches."""
    every = [(d, k, w) for d in sorted(docs) for k, w in enumerate(lines(docs[d])) if len(w) < 1000]
    group = {(d, k): (d, k) for d, k, _ in every}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for (d, k, a), (e, m, b) in itertools.combinations(every, 2):
        if len(a) <= 1.5 * len(b) and len(b) <= 1.5 * len(a) and jaccard(a, b) >= SIMILARITY:
            low, high = sorted((root((d, k)), root((e, m))))
            group[high] = low
    return {x: root(x) for x in group}


def test_paragraphs_match_brute_force_over_all_pairs(spark):
    docs, _ = make()
    own = {d: Passages(t) for d, t in docs.items() if t}
    expected, at = {}, {}
    for d in own:
        first, last = own[d].paragraphs(LEAST_WORDS)
        assert [list(w) for w in lines(docs[d])] == [words(docs[d])[a:b] for a, b in zip(first, last, strict=True)]
        at |= {(d, k): (int(a), int(b)) for k, (a, b) in enumerate(zip(first, last, strict=True))}
    for x, r in paragraph_components(docs).items():
        if x != r:
            expected[x[0], *at[x]] = r[0]
    got = {(r.doc, r.start, r.end): r.first_doc for r in repeats(frame(spark, docs)).collect()}
    assert sum(x in got for x in expected) >= 0.97 * len(expected) > 40
    assert all(got.get(x, r) == r for x, r in expected.items())
    # nothing else that is a whole paragraph, but for tiles that happen to be one
    everything = {(d, *v) for (d, _), v in at.items()}
    for d, a, b in (got.keys() & everything) - expected.keys():
        assert d == 134 or any(" ".join(words(docs[d])[a:b]) in " ".join(words(t)) for e, t in docs.items() if e <= d)


def test_what_goes_is_a_repeat(spark):
    """Each removed word lies in a paragraph that is like an earlier one, or in five words that stand earlier as well."""
    docs, _ = make(2)
    component = paragraph_components(docs)
    seen, fine = set(), {}
    for d in sorted(docs):
        w, here = words(docs[d]), set()
        for i in range(len(w) - SHINGLE + 1):
            s = tuple(w[i : i + SHINGLE])
            if s in seen:
                here |= set(range(i, i + SHINGLE))
            seen.add(s)
        own = Passages(docs[d] or "")
        for k, (a, b) in enumerate(zip(*own.paragraphs(LEAST_WORDS), strict=True)):
            if (d, k) in component and component[d, k] != (d, k):
                here |= set(range(a, b))
        fine[d] = here
    n = 0
    for r in repeated_passages(frame(spark, docs)).collect():
        own = Passages(docs[r.doc_id])
        inside = set(np.flatnonzero((own.starts >= r.start) & (own.ends <= r.end)).tolist())
        assert len(inside) == r.n_words >= LEAST_WORDS and inside <= fine[r.doc_id]
        n += len(inside)
    assert n > 3000


def test_passages_go_and_clean_documents_stay(spark):
    docs, passages = make()
    df = frame(spark, docs)
    rest = {r.doc_id: r for r in without_repeats(df).collect()}
    assert sorted(rest) == sorted(docs) and all(rest[d].hash == "x" for d in rest)
    for d in [*range(68), 131, 132, 133]:
        assert rest[d].text == docs[d]
    for d in range(68, 90):
        assert passages[d % 8] not in rest[d].text and len(rest[d].text.split()) < len(docs[d].split()) - 15
    assert len(rest[90].text.split()) < 30 and len(rest[134].text.split()) <= 128
    joined = " ".join(r.text or "" for r in rest.values())
    assert all(joined.count(p) == 1 for p in passages)


@pytest.mark.parametrize("length", [60, 100])
def test_recall_of_substituted_paragraphs(spark, length):
    """Paragraphs with one word in sixty changed, in documents of their own."""
    rng = random.Random(7)
    known, docs, pairs = vocabulary(rng), {}, 0
    for i in range(300):
        w = rng.choices(known, k=length)
        other = list(w)
        for k in rng.sample(range(length), length // 60):
            other[k] = "changed"
        docs[2 * i], docs[2 * i + 1] = " ".join(w), " ".join(other)
        pairs += jaccard(w, other) >= SIMILARITY
    found = {r.doc_id for r in repeated_passages(frame(spark, docs)).collect() if r.n_words == length}
    assert len(found) >= 0.97 * pairs and pairs > 290 and all(d % 2 for d in found)


def test_recall_of_passages_of_over_fifty_words(spark):
    rng = random.Random(8)
    known, docs = vocabulary(rng), {}
    for i in range(300):
        passage = rng.choices(known, k=52)
        for k in (2 * i, 2 * i + 1):
            docs[k] = " ".join([*rng.choices(known, k=rng.randint(0, 60)), *passage, *rng.choices(known, k=rng.randint(0, 60))])
    found = {r.doc_id: r.n_words for r in repeated_passages(frame(spark, docs)).collect()}
    assert all(d % 2 for d in found) and len(found) >= 0.98 * 300
    assert sum(found.values()) >= 0.7 * 300 * 52


def test_least_words_is_free(spark):
    docs = {1: "one two three four five six\nother words stand here too now", 2: "begin\nOne two three four five six\nagain nothing that was here before", 3: "one two three four\none two three four"}
    assert repeated_passages(frame(spark, docs)).count() == 0
    rest = {r.doc_id: r.text for r in without_repeats(frame(spark, docs), least_words=5).collect()}
    assert rest == {1: docs[1], 2: "begin\nagain nothing that was here before", 3: docs[3]}


def test_repeated_rows_null_ids_clashing_names_and_no_rows(spark):
    docs, passages = make()
    df = spark.createDataFrame([(1, passages[0]), (1, passages[0]), (None, passages[0]), (2, "start " + passages[0]), (2, passages[1])], "doc_id long, text string")
    assert {(r.doc_id, r.first_doc_id) for r in repeated_passages(df).collect()} == {(2, 1)}
    clash = ("gone", "own_id", "GONE_KEY", "doc", "key", "hash", "start", "component", "first_doc")
    wide = df.selectExpr("*", *[f"{k} AS {c}" for k, c in enumerate(clash)])
    back = without_repeats(wide)
    assert back.columns == wide.columns and all(list(r)[2:] == list(range(len(clash))) for r in back.collect())
    rest = sorted((r.doc_id or 0, r.text) for r in back.collect())
    assert [r for r in rest if r[0] != 2] == [(0, passages[0]), (1, passages[0]), (1, passages[0])] and (2, passages[1]) in rest
    assert repeated_passages(df.limit(0)).count() == 0 and without_repeats(df.limit(0)).count() == 0


def test_places_and_huge_words():
    text = "  Ab\n\ncd\te f  " + "g" * 600_000 + " h"
    s = Passages(text)
    assert [text[a:b] for a, b in zip(s.starts, s.ends, strict=True)] == text.split()
    assert len(set(s.words.tolist())) == 6
    assert cut("a b", []) == "a b" and spans("a b", [(0, 9, 1, 1)]) == []
    tiles = lambda t: len(Passages(t).tiles()[0])
    assert tiles("x " * 500) == tiles(" x" * 500) > 0


def test_unique_words_between_repeats_stay(spark):
    rng = random.Random(9)
    known = vocabulary(rng)
    one, two, own = (rng.choices(known, k=k) for k in (60, 60, 14))
    docs = {1: " ".join(one), 2: " ".join(two), 3: " ".join([*one, *own, *two])}
    rest = {r.doc_id: r.text for r in without_repeats(frame(spark, docs)).collect()}
    assert " ".join(own) in rest[3] and len(rest[3].split()) < 60


def test_bands_are_tuned():
    n = bands_for(SIMILARITY, RECALL, 2)
    assert n == 5 and 1 - (1 - SIMILARITY**2) ** n >= RECALL > 1 - (1 - SIMILARITY**2) ** (n - 1)


def test_links_join_all_alike_pairs_of_a_hot_band(spark, monkeypatch):
    rng = random.Random(6)
    sets = []
    for _ in range(150):
        s = set(rng.sample(range(3, 2**31), rng.randint(9, 40))) | {1, 2}
        other = set(s)
        other.remove(rng.choice(sorted(s - {1, 2})))
        sets += [s, other | {rng.randrange(3, 2**31)}] if len(s) > 18 else [s, other]
    sets += [set(sets[0])]
    rows = [(b, 1000 * b + i, sorted(s)) for b in (7, 8) for i, s in enumerate(sets)]
    group = {h: h for _, h, _ in rows}

    def root(h):
        while group[h] != h:
            h = group[h]
        return h

    for (a, h, s), (b, g, t) in itertools.combinations(rows, 2):
        if a == b and len(set(s) & set(t)) >= SIMILARITY * len(set(s) | set(t)):
            low, high = sorted((root(h), root(g)))
            group[high] = low
    expected = {h: root(h) for h in group if sum(root(g) == root(h) for g in group) > 1}
    members = spark.createDataFrame(rows, "key long, hash long, shingles array<int>")
    for tile, total, width in ((512, 1 << 19, 4096), (20, 1 << 19, 16), (512, 700, 64)):
        monkeypatch.setattr(substrings, "TILE", tile)
        monkeypatch.setattr(substrings, "TILE_SHINGLES", total)
        monkeypatch.setattr(substrings, "WIDTH", width)
        got = {r.node: r.component for r in connected_components(alike_links(members)).collect()}
        assert got == expected


def test_many_texts_are_worked_on_at_once_with_the_passages_of_each():
    docs, _ = make(3)
    texts = [*docs.values(), "\ud800 x 😀 y　z", " \n ", None, *[f"{k} {docs[k]}" for k in range(20)], None]
    batch = substrings.Batch(texts, LEAST_WORDS)
    assert len(batch.own.firsts) == len(texts) + 1
    got = list(zip(batch.of.tolist(), batch.words(0).tolist(), batch.words(1).tolist(), batch.hashes().tolist(), batch.checks().tolist(), strict=True))
    values, starts, ends = batch.shingles()
    sets = [values[a:b].tolist() for a, b in zip(starts, ends, strict=True)]
    tiles, paragraphs, own_sets, gone = [], [], [], []
    for i, t in enumerate(texts):
        own = Passages(t or "")
        here = [[(i, a, b, h, c) for a, b, h, c in zip(*(x.tolist() for x in (*w, own.hashes(*w), own.checks(*w))), strict=True)] for w in (own.tiles(), own.paragraphs(LEAST_WORDS))]
        tiles += here[0]
        paragraphs += here[1]
        own_sets += [own.shingles()[a : b - SHINGLE + 1].tolist() for _, a, b, *_ in here[1]]
        # another row's entries don't count
        gone.append([(a, b, h ^ (a % 7 == 3), a) for _, a, b, h, _ in here[0] + here[1] if a % 3])
    assert got == tiles + paragraphs and sets == own_sets and len(paragraphs) > 100
    assert list(substrings.spans_of(texts, gone)) == [spans(t or "", g) for t, g in zip(texts, gone, strict=True)]
