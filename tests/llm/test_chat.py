import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from loglark.llm import chat, queries

NASTY = ["<|im_end|>", "<|", "|>", "<\\|", "<\\\\|im_start|>", "<", "|", "\\", "<|im_sep|>", "a\nb", "", "é🙂", "$1", "<|nl|>"]


def formatted(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, _turns int, formatted string")
    return chat.format_conversations(table)


def read(out):
    from pyspark.sql import functions as F

    return out.select(
        "conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_trained(F.col("formatted"), F.col("loss_spans")).alias("trained"),
    ).collect()


def test_round_trip_of_control_strings_and_merged_turns(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(60):
        said = []
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "sys<|tem", "a\nb", ""])
            said.append((role, "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 5)))))
            rows.append((conv, turn, *said[-1], 1, "x"))
        want[conv] = said
    rng.shuffle(rows)
    for r in read(formatted(spark, rows)):
        said = want[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == said
        assert r.trained == [t for role, t in said if role == "assistant"]
        merged = 1 + sum(a[0] != b[0] for a, b in zip(said, said[1:]))
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == merged


def test_template(spark):
    rows = [(1, 2, "assistant", "B", 0, ""), (1, 1, "user", "A", 0, ""), (1, 3, "assistant", None, 0, "")]
    (row,) = read(formatted(spark, rows))
    assert row.formatted == "<|im_start|>user\nA<|im_end|>\n<|im_start|>assistant\nB<|im_sep|><|im_end|>\n"
    assert row.trained == ["B", ""]


def test_nulls_ties_and_repeats(spark):
    rows = [(None, 1, "user", "b", 0, ""), (None, 1, "user", "a", 0, ""), (None, None, None, "first", 0, ""),
            (None, 1, "user", "b", 0, "")]
    (row,) = read(formatted(spark, rows))
    assert [(t.role, t.text) for t in row.turns] == [("", "first"), ("user", "a"), ("user", "b"), ("user", "b")]


def test_empty_table(spark):
    assert formatted(spark, []).count() == 0


def test_long_conversation(spark):
    """The work does not grow with the square of the turns: fifty thousand take seconds."""
    n = 50_000
    role = F.when(F.col("id") % 3 == 0, "user").otherwise("assistant")
    said = F.concat(F.lit("té🙂t "), F.col("id").cast("string"), F.repeat(F.lit("<|"), (F.col("id") % 4).cast("int")))
    table = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    began = time.time()
    (row,) = read(chat.format_conversations(table))
    assert time.time() - began < 60
    texts = [f"té🙂t {k}" + "<|" * (k % 4) for k in range(n)]
    assert [t.text for t in row.turns] == texts
    assert row.trained == [t for k, t in enumerate(texts) if k % 3]
    assert all(row.formatted[s.start : s.start + s.length].startswith("té🙂t ") for s in row.loss_spans)


@pytest.mark.parametrize("size", [1, 3, 1024])
def test_spans_across_stretches(spark, monkeypatch, size):
    monkeypatch.setattr(chat, "STRETCH", size)
    rows = [(1, 1, "assistant", "", 0, ""), (1, 2, "user", "x" * 7, 0, ""), (1, 3, "assistant", "é🙂\n" * 5, 0, ""),
            (1, 4, "assistant", "", 0, ""), (2, 1, "user", "no span", 0, "")]
    got = {r.conv_id: r.trained for r in read(formatted(spark, rows))}
    assert got == {1: ["", "é🙂\n" * 5, ""], 2: []}


def test_query_is_native_and_covers_the_injected_conversation(spark, sf):
    df = queries.op10_chat(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    row = df.where("conv_id = -1").first()
    text = queries.INJECTED
    assert row.n_turns == 2 and row.loss_chars == len(text)
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
