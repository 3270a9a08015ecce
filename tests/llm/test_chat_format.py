import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoprev.llm import chat_format as C

ROWS = "conv_id long, turn long, role string, text string, state string"
T = C.Template()


def show(spark, rows):
    df = C.format_chats(spark.createDataFrame([(*r, "clash") for r in rows], ROWS), T)
    return {r.conv_id: r for r in df.withColumn("back", C.read_back(F.col("formatted"), T)).collect()}


def test_states_and_losses(spark):
    got = show(spark, [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "x"), (3, 0, "assistant", "first"), (4, 0, "user", "open"),
                       (5, 0, "user", None), (5, 1, None, "?"), (6, 0, "user", "twice"), (6, 0, "user", "twice")])
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert [(x.role, x.text) for x in got[1].back] == [("user", "a"), ("assistant", "b")]
    assert [x.text for x in got[2].segments if x.loss] == ["x"]
    assert [(x.role, x.text) for x in got[5].back] == [("user", ""), ("", "?")]
    assert len(got[6].back) == 2
    assert "".join(x.text for x in got[2].segments) == got[2].formatted


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|turn|>", "<|text|>", "<|end|>", "\n", "\\", "<", "<\\|turn|>", "</s>", "[INST]", "[/INST]", "[", "é", "x", "\\Q"]), max_size=8).map("".join), min_size=1, max_size=12))
def test_round_trip(spark, texts):
    got = show(spark, [(i, 0, "user", t) for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        assert [(x.role, x.text) for x in got[i].back] == [("user", t)]
        assert all(s not in got[i].segments[1].text for s in T.controls)


def test_templates_are_checked():
    with pytest.raises(ValueError):
        C.Template(head="ab", mid="ba")


def test_empty(spark):
    assert C.format_chats(spark.createDataFrame([], ROWS)).count() == 0


def test_very_long_texts(spark):
    """A million letters with control strings, and a thousand turns."""
    long = "word </s> <|turn|> " * 50_000
    turns = [(2, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(1000)]
    got = show(spark, [(1, 0, "user", long), (1, 1, "assistant", long), *turns])
    assert [(x.role, x.text) for x in got[1].back] == [("user", long), ("assistant", long)] and got[1].valid
    assert [(x.role, x.text) for x in got[2].back] == [(r, t) for _, _, r, t in turns] and got[2].valid
