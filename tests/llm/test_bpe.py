import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from topspin.llm.bpe import MergeAutomaton, WordTokenizer, digests, encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\t", "a\x1cb", "İstanbul ΣΑΣ it's don't <|endoftext|>x <|startoftext|>", "😀😀 naïve x y﻿ z", "x" * 3000, "é ͅ ﬁ Ǆ 12345 ١٢٣ ½²",
    "日本語テキスト ไทย हिन्दी", "\x00\x01 a", "<|endoftext|>", "foo<|endoftext|>", "word " * 30_000, "THE the The", " a\xa0b　c",
]


def by_rank(word, merges, suffix):
    """Merges the pair of least rank, the leftmost first, until none is left."""
    parts = [*word[:-1], word[-1] + suffix]
    rank = {m: i for i, m in enumerate(merges)}
    while True:
        best = min((p for p in zip(parts, parts[1:], strict=False) if p in rank), key=rank.get, default=None)
        if best is None:
            return parts
        out = []
        for p in parts:
            if out and (out[-1], p) == best and out[-1] is not None:
                out[-1] = out[-1] + p
                out.append(None)
            else:
                if out and out[-1] is None:
                    out.pop()
                out.append(p)
        parts = [p for p in out if p is not None]


@pytest.mark.parametrize("suffix", ["", "</w>"])
@pytest.mark.parametrize("seed", range(6))
def test_automaton_does_what_ranked_merges_do(seed, suffix):
    rng = random.Random(seed)
    base = [c + s for c in "abc" for s in {"", suffix}]
    labels, merges = list(base), []
    for _ in range(25):
        u, v = rng.choice(labels), rng.choice(labels)
        if (not suffix or not u.endswith(suffix)) and u + v not in labels:
            merges.append((u, v))
            labels.append(u + v)
    automaton = MergeAutomaton({s: i for i, s in enumerate(labels)}, merges, suffix)
    for _ in range(400):
        word = "".join(rng.choices("abc", k=rng.randint(1, 14)))
        assert automaton.decode(automaton.encode(word)) == by_rank(word, merges, suffix), (word, merges)


def test_same_as_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rows = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate([*ODD, *ODD])], "doc_id long, text string, key int, ids string")
    encoded = encode_documents(rows, PATH)
    got = {r.doc_id: r for r in encoded.collect()}
    marks = {r.doc_id: r for r in digests(encoded).collect()}
    for i, text in enumerate([*ODD, *ODD]):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids and got[i].decoded == decoded, text
        assert marks[i].n_tokens == len(ids)
        assert marks[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert marks[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_full_memory_changes_nothing_and_no_rows(spark):
    coder = WordTokenizer(PATH)
    coder.ROOM = 3
    texts = [t for t in ODD if t] * 2
    assert [coder.encode(t) for t in texts] == [WordTokenizer(PATH).encode(t) for t in texts]
    assert np.frombuffer(coder.encode("a")[0], np.int32).size == 1
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_unknown_symbols_and_ambiguous_merges():
    with pytest.raises(KeyError):
        MergeAutomaton({"a": 0}, []).encode("b")
    with pytest.raises(ValueError):
        MergeAutomaton({s: i for i, s in enumerate(["a", "b", "ab", "ba", "aba"])}, [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "ba")])
