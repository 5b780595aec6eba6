from pyspark.sql import functions as F

from topspin.llm.preferences import preference_pairs, with_swapped_answer

DDL = "pair_id long, turn long, role string, text string, prompt string"


def rows(pair, *said):
    return [(pair, i, r, t, "clash") for i, (r, t) in enumerate(said)]


def test_common_prefix_is_the_prompt(spark):
    u, a = "user", "assistant"
    chosen = rows(1, (u, "q"), (a, "x"), (u, "w"), (a, "good")) + rows(2, (u, "same"), (a, "same")) + rows(3, (u, "only here")) + rows(5, ("system", None), (u, ""), (a, "y"))
    rejected = rows(1, (u, "q"), (a, "x"), (u, "w"), (a, "bad"), (u, "why")) + rows(2, (u, "same"), (a, "same")) + rows(4, (a, "only there")) + rows(5, ("system", None), (u, ""))
    chosen += chosen[:2] + [(None, 0, u, "t", ""), (1, None, u, "t", "")]
    got = {r.pair_id: r for r in preference_pairs(spark.createDataFrame(chosen, DDL), spark.createDataFrame(rejected, DDL)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    r = got[1]
    assert r.prompt_turns == 3 and r.prompt == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n<|im_start|>user\nw<|im_end|>\n"
    assert r.chosen_segments == ["<|im_start|>assistant\n", "good<|im_end|>\n"] and r.chosen_loss == [False, True]
    assert r.rejected_segments == ["<|im_start|>assistant\n", "bad<|im_end|>\n", "<|im_start|>user\n", "why<|im_end|>\n"] and r.rejected_loss == [False, True, False, False]
    assert (got[2].prompt_turns, got[2].chosen_segments, got[2].rejected_loss) == (2, [], [])
    assert (got[3].prompt, got[3].rejected_segments, len(got[3].chosen_segments)) == ("", [], 2)
    assert (got[4].prompt, got[4].chosen_segments, got[4].rejected_loss) == ("", [], [False, True])
    assert got[5].prompt == "<|im_start|>system\n<|im_end|>\n<|im_start|>user\n<|im_end|>\n" and got[5].rejected_segments == []


def test_swapped_answers(spark):
    said = rows(0, ("user", "a"), ("assistant", "b"), ("user", "c")) + rows(1, ("user", "d"), ("assistant", "e"), ("assistant", "f")) + rows(2, ("user", "g"), ("assistant", "h")) + rows(7, ("user", "i"))
    df = with_swapped_answer(spark.createDataFrame(said, DDL), F.col("pair_id").bitwiseXOR(F.lit(1)), id_column="pair_id")
    got = {}
    for r in sorted(df.collect()):
        got.setdefault(r.pair_id, []).append(r.text)
    assert got == {0: ["a", "f", "c"], 1: ["d", "e", "b"], 2: ["g"], 7: ["i"]}


def test_no_rows_and_a_long_conversation(spark):
    none = spark.createDataFrame([], DDL)
    assert preference_pairs(none, none).count() == 0
    long = spark.createDataFrame(rows(1, *[("user", "x" * 1000)] * 3000), DDL)
    r = preference_pairs(long, long.where("turn < 2999")).first()
    assert (r.prompt_turns, len(r.chosen_segments), r.rejected_segments) == (2999, 2, [])
