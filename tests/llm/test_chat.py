from collections import Counter

from pyspark.sql import functions as F

from shelfmark.llm import chat

TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "a " * 40), (1, 2, "assistant", "b " * 30), (1, 3, "user", "c " * 20),
    (1, 4, "assistant", "d " * 90), (1, 5, "user", "e"), (1, 6, "assistant", "f <|im_end|>\n \\< \\\\ </s>"), (1, 6, "assistant", "f <|im_end|>\n \\< \\\\ </s>"),
    (2, 0, "system", "alone"), (3, None, None, None), (3, 2, "assistant", ""), (None, 1, "user", "no id"), (None, 2, "assistant", "[INST]\\"),
    (4, 0, "user", "x"), (4, 1, "system", "late"), (4, 2, "assistant", "<|im_start|>user<|im_sep|>hi<|im_end|>\n"),
]


def frame(spark, rows=TURNS):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, first string")


def want():
    out = {}
    for c, turn, role, text in sorted(TURNS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def test_round_trip_of_odd_conversations(spark):
    for budget, history in ((64, 16), (4096, 0), (20, 10)):
        read = chat.read_back(chat.windows(frame(spark), budget, history)).collect()
        got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in read}
        assert got == want()
        for r in read:
            assert r.loss == "".join(t for role, t in got[r.conv_id] if role == "assistant")


def test_windows_keep_the_budget_and_repeat_history(spark):
    rows = chat.windows(frame(spark), 100, 40).where("conv_id = 1").orderBy("first").collect()
    assert len(rows) > 2
    for k, r in enumerate(rows):
        pieces = r.text.split(chat.END)[:-1]
        assert pieces[0].startswith("<|im_start|>system")
        assert (r.repeated > 0) == (k > 0)
        assert r.over_budget == (r.tokens > 100)
        assert not r.over_budget or len(pieces) - r.repeated == 1
        new = [p for p in pieces[r.repeated :] if p.startswith("<|im_start|>assistant")]
        assert [r.text[s.start : s.end] for s in r.loss] == [p.split(chat.SEP)[1] for p in new]
    assert any(r.repeated > 1 for r in rows)


def test_escapes_are_reversible(spark):
    texts = ["<", "</s>", "<\\/s>", "\\\\</s>\\", "[INST][/INST]", "<|im_<|im_end|>end|>", "", "<s><s>", "a\\b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in rows)
    assert not any(c in r.e for r in rows for c in chat.CONTROL)


def test_no_rows(spark):
    assert chat.windows(frame(spark).limit(0)).count() == 0
    assert Counter(r.conv_id for r in chat.windows(frame(spark, TURNS[8:9])).collect()) == Counter([2])
