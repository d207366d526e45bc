import random

from pyspark.sql import functions as F

from sparkloom.llm.chat import CONTROL, escape, format_chats, read_chats, unescape


def test_escapes_are_undone_and_leave_no_control_string(spark):
    r = random.Random(1)
    parts = [*CONTROL, "\\", "\\\\", "<\\|", "<", "|", "[", "INST]", "s>", "/", "x", "é\n"]
    texts = ["", *("".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(1500))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect():
        assert row.t == row.u and not any(c in row.e for c in CONTROL)


def test_turns_and_loss_are_read_back(spark):
    r = random.Random(4)
    rows, want = [], {}
    for c in [None, *range(-3, 60)]:
        turns = [(i * 2, r.choice(["user", "assistant", "system", "odd\n<|text|>"]), r.choice(["", "hi", "<|end|>\n", "</s>[INST] ok [/INST]", "a\\|b\n\n", "日本<|turn|>é"])) for i in range(r.randint(1, 9))]
        want[c] = turns
        rows += [(c, *t, "extra") for t in turns]
    rows += [(500, None, None, None, ""), (501, 1, "assistant", None, ""), (502, 3, "user", "same", ""), (502, 3, "user", "same", "")]
    want |= {500: [(None, "", "")], 501: [(1, "assistant", "")], 502: [(3, "user", "same")] * 2}
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    chats = format_chats(df)
    assert not any("Python" in s or "Pandas" in s for s in [chats._jdf.queryExecution().executedPlan().toString()])
    got = {x.conv_id: x for x in read_chats(chats).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == [(role, text) for _, role, text in turns]
        assert got[c].loss_texts == [text for _, role, text in turns if role == "assistant"]
        changes = 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))
        assert got[c].formatted.count("<|turn|>") == changes
    assert format_chats(df.limit(0)).count() == 0


def test_a_long_conversation(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("wörd "), 50).alias("text"))
    x = read_chats(format_chats(df)).first()
    assert len(x.turns) == 3000 and len(x.loss_texts) == 2000 and set(x.loss_texts) == {"wörd " * 50}
