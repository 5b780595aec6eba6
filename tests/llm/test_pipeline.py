import random
import re
import zlib

import corpus_pipeline
from topspin.llm import quality, simhash, substrings
from topspin.llm.shared import table

ROOT = "/root/testdata/sf0.001"


def components(fps):
    group = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 3 and group[j] < group[i]:
                    group[i], changed = group[j], True
    return group


def test_stages_against_brute_force(spark, tmp_path):
    documents = [tuple(r) for r in table(spark, ROOT, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    item = table(spark, ROOT, "benchmark").first().text
    more = [" ".join(rng.choices(vocabulary, k=90)) for _ in range(4)]
    documents += [(10_000, f"{more[0]} {passage} {more[1]}", "en", "s", 0), (10_001, f"{more[2]} {passage}", "en", "s", 0), (10_002, f"{more[3]} {item} {more[3][:40]}", "en", "s", 0), (10_003, documents[7][1], "en", "s", 0)]
    docs = spark.createDataFrame(documents, table(spark, ROOT, "documents").select("doc_id", "text", "lang", "source", "n_chars").schema)
    columns = docs.columns

    scored = {r.doc_id: r.predicted for r in quality.score(docs, quality.train(docs, table(spark, ROOT, "labels"))).collect()}
    one = corpus_pipeline.quality_filter(spark, docs, ROOT)
    assert one.columns == columns
    kept = {r.doc_id: r for r in one.collect()}
    assert set(kept) == {d for d, p in scored.items() if p == 1}
    labels = {r.doc_id: r.quality for r in table(spark, ROOT, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum((d in kept) == bool(q) for d, q in labels.items()) > 0.9 * len(labels)

    two = corpus_pipeline.near_dedup(spark, one, ROOT)
    group = components({d: simhash.fingerprint(r.text) for d, r in kept.items()})
    assert two.columns == columns
    left = {r.doc_id: r for r in two.collect()}
    assert set(left) == {d for d, c in group.items() if c == d}

    three = corpus_pipeline.substring_dedup(spark, two, ROOT)
    assert three.columns == columns
    cut = {r.doc_id: r for r in three.collect()}
    assert set(cut) == set(left) and all(r.n_chars == len(r.text) for r in cut.values())
    gone = {}
    for r in substrings.repeats(two).collect():
        gone.setdefault(r.doc, []).append((r.start, r.end, r.hash, r.first_doc))
    assert all(r.text == substrings.cut(left[d].text, gone.get(d, [])) for d, r in cut.items())
    if 10_000 in cut and 10_001 in cut:
        assert passage in cut[10_000].text and len(cut[10_001].text.split()) < 90 + 40

    four = corpus_pipeline.decontaminate(spark, three, ROOT)
    assert four.columns == columns
    clean = {r.doc_id for r in four.collect()}
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [words(r.text) for r in table(spark, ROOT, "benchmark").collect()]
    for d, r in cut.items():
        joined = " ".join(words(r.text))
        assert not (d in clean and any(" ".join(i) in joined for i in items))
    assert 10_002 not in clean and len(clean) > 0.8 * len(cut)

    five = corpus_pipeline.encode(spark, four, ROOT)
    assert {r.doc_id for r in five.collect()} == clean


def test_texts_under_one_id_are_documents_of_their_own(spark):
    rng = random.Random(3)
    a, b, c = (" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80)) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (5, b), (7, c), (7, None), (8, ""), (None, a), (None, c), (9, c + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(map(str, map(tuple, corpus_pipeline.near_dedup(spark, docs, ROOT).collect())))
    near = (simhash.fingerprint(c) ^ simhash.fingerprint(c + " more")).bit_count() <= 3
    wanted = [(1, a), (5, b), (7, c), (7, None), (None, a), (None, c)] + [(9, c + " more")] * (not near)
    assert left == sorted(map(str, wanted))


def test_run_is_its_stages(spark):
    docs = table(spark, ROOT, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, ROOT))
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, ROOT).collect()))


def test_no_documents(spark):
    docs = table(spark, ROOT, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, ROOT)
    assert docs.count() == 0


def test_null_and_empty_texts_go_through_all_stages(spark):
    """A null text counts as empty in every stage; empty ones are copies of each other, null ids stay."""
    schema = table(spark, ROOT, "documents").select("doc_id", "text", "lang", "source", "n_chars").schema
    some = [tuple(r) for r in table(spark, ROOT, "documents").select("doc_id", "text", "lang", "source", "n_chars").limit(60).collect()]
    odd = [(9_000, None, None, None, None), (9_001, "", "en", "s", 0), (9_002, " \n", "en", "s", 2), (None, None, None, None, None), (None, some[0][1], "en", "s", 0)]
    docs = spark.createDataFrame(some + odd, schema)
    assert corpus_pipeline.quality_filter(spark, docs, ROOT).columns == docs.columns
    deduped = corpus_pipeline.near_dedup(spark, docs, ROOT)
    left = [r for r in deduped.collect() if r.doc_id is None or r.doc_id >= 9_000]
    assert sorted(repr(r.doc_id) for r in left) == ["9000", "None", "None"]
    rows = docs
    for name, stage in corpus_pipeline.STAGES[2:-1]:
        rows = stage(spark, rows, ROOT)
        assert rows.columns == docs.columns, name
        kept = [r for r in rows.collect() if r.doc_id is None or r.doc_id >= 9_000]
        assert len(kept) == 5 and all(not (r.text or "").strip() for r in kept if r.doc_id is not None), name
    done = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, ROOT).where("doc_id >= 9000").collect()}
    assert done[9_000].n_tokens == done[9_001].n_tokens == 0 and done[9_000].ids_sha256 == done[9_001].ids_sha256
