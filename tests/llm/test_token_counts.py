import public_tokenizers
import sentencepiece

from topspin.llm.token_counts import UnitCounter, count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a ", "a  b", " a", "▁a▁ b", "a▁", "<s> x</s> <unk>", "\n a\n", "日本 語 😀", "\x00 a\x00b", "a\tb  ", "x" * 50_000, "many words " * 20_000, "é" * 10]


def test_same_as_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = spark.createDataFrame([(i % 20, t, -1) for i, t in enumerate([*ODD, *ODD])], "doc_id long, text string, n_tokens int")
    got = sorted(tuple(r) for r in count_tokens(rows, PATH).collect())
    assert got == sorted((i % 20, len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate([*ODD, *ODD]))
    assert count_tokens(rows.limit(0), PATH).count() == 0


def test_small_batches_and_a_full_memory_change_nothing():
    texts = [t for t in ODD if t]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    counter = UnitCounter(PATH, room=2, batch_bytes=4)
    assert counter.safe
    for _ in range(2):
        for t in texts:
            assert counter.counts([t, "", t]) == [len(library.encode(t)), 0, len(library.encode(t))]
