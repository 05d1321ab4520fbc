"""Chat formatting in budgeted windows, with DataFrame functions only.

The prefix sums of a conversation's turn tokens choose turn-aligned spans.  With R tokens of room (the budget less the
history and the system turn, and at least a quarter of the budget), the turns whose prefix starts in the same
stretch of R tokens form a span; only the last of them can reach past the room, and then it becomes a span of its own.
So every span fits unless it is one long turn (``over_budget``); no text is cut.  A window is the system turn, the
last turns before the span that fit ``history`` tokens, and the span.  The loss mask has the assistant texts of the
span only: what a window repeats is masked.

    <|im_start|>{role}<|im_sep|>{text}<|im_end|>\\n        for each turn

Control strings inside roles and texts get a backslash after their first character, and backslashes are doubled,
so no text can hold a mark and ``unescaped`` restores it exactly.

A conversation may hold a third of all turns: running totals are range partitioned by (conversation,
turn), and every grouping here is one stretch or window, whose size the budget bounds.  Only the digest of a
whole conversation (``read_back``, which returns its turns in order) needs it in one row.

Defined cases: NULL role or text is empty.  Turns go by (turn, role, a hash of the text), NULL first; repeated rows are turns of their
own.  Rows of NULL conv_id form one conversation.  The system turn is a first turn with role ``system``; any other
system turn is an ordinary one without loss.  An empty table gives no windows.  Extra columns are not carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import written
from shelfmark.operators.ordered import running_total

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Strings with a meaning in this template or in widespread others.
CONTROL = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]"]
#: Tokens are words, single marks, and the marks around a turn.
TOKEN, TURN_TOKENS = r"[\p{L}\p{N}_]+|[^\x20\x09-\x0D\p{L}\p{N}_]", 4


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(x[0] + "\\" + x[1:])), CONTROL, doubled)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def windows(turns: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """conv_id, first (tokens before the span: the order of windows), text, loss (code point spans in
    ``text``), tokens, repeated (leading turns that an earlier window has as new ones), over_budget."""
    if not 0 <= history < budget:
        raise ValueError("history must be below the budget")
    text = F.coalesce("text", F.lit(""))
    base = written(turns.select(
        F.monotonically_increasing_id().alias("id"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        escaped(F.coalesce("role", F.lit(""))).alias("mark"), escaped(text).alias("body"), F.xxhash64("text").alias("h"),
        (F.regexp_count(text, F.lit(TOKEN)) + TURN_TOKENS).cast("long").alias("tokens"),
    ), "chat-turns")
    # All placing is done on numbers; the texts join at the end, once for each window they stand in.
    light = base.select("id", "conv_id", "turn", "role", "h", "tokens")
    order = [F.col("turn"), F.col("role"), F.col("h"), F.col("id")]
    summed = running_total(light, ["conv_id"], order, F.col("tokens"), "stop")
    rows = written(summed.select("id", "conv_id", "role", "tokens", (F.col("stop") - F.col("tokens")).alias("start"), "stop"), "chat-sums")
    opening = rows.groupBy("conv_id").agg(F.min_by(F.struct("id", "role", "tokens"), "start").alias("system"), F.max("stop").alias("total"))
    # A conversation of nothing but its system turn keeps it as an ordinary turn, and so gets a window.
    system = opening.where("system.role = 'system' AND total > system.tokens").select(F.col("conv_id").alias("sys_id"), "system")
    ahead = F.coalesce("system.tokens", F.lit(0))
    room = F.greatest(budget - history - ahead, F.lit(max(1, budget // 4)))
    content = rows.join(system, F.col("conv_id").eqNullSafe(F.col("sys_id")), "left").where(F.col("start") >= ahead).withColumns(
        {"room": room, "stretch": F.floor((F.col("start") - ahead) / room)}
    )
    begin = F.min("start").over(W.partitionBy("conv_id", "stretch"))
    spanned = written(content.withColumn("begin", begin).select(
        "id", "conv_id", "start", "stop", "system",
        F.when(F.col("stop") - F.col("begin") > F.col("room"), F.col("start")).otherwise(F.col("begin")).alias("first"),
    ), "chat-spans")
    spans = spanned.groupBy("conv_id", "first").agg(F.first("system").alias("system"))
    # A turn that starts at most ``history`` tokens before a span is no longer than that, and lies in the
    # span's cell or the one before.
    cell = lambda c: F.floor(F.col(c) / max(history, 1))
    near = spanned.where(F.col("stop") - F.col("start") <= history).select(
        "id", F.col("conv_id").alias("h_id"), F.col("start").alias("h_start"), F.col("first").alias("h_first"),
        F.explode(F.array(cell("start"), cell("start") + 1)).alias("h_cell"),
    )
    before = spans.select("conv_id", "first", cell("first").alias("cell")).join(
        near, F.col("conv_id").eqNullSafe(F.col("h_id")) & (F.col("cell") == F.col("h_cell"))
        & (F.col("h_first") < F.col("first")) & (F.col("h_start") >= F.col("first") - history),
    )
    opens = F.col("first") == F.col("system.tokens")  # here the system turn is new
    placed = (
        spanned.select("id", "conv_id", "first", "start", F.lit(False).alias("again"))
        .unionByName(before.select("id", "conv_id", "first", F.col("h_start").alias("start"), F.lit(True).alias("again")))
        .unionByName(spans.where("system IS NOT NULL").select(
            "system.id", "conv_id", "first", F.lit(0).cast("long").alias("start"), (~opens).alias("again")
        ))
    )
    turn = F.struct("start", "role", "mark", "body", "tokens")
    parts = placed.join(base.select("id", "role", "mark", "body", "tokens"), "id").groupBy("conv_id", "first").agg(
        F.sort_array(F.collect_list(turn)).alias("parts"), F.count_if("again").cast("int").alias("repeated")
    )
    return _formatted(parts, budget)


def _formatted(parts: DataFrame, budget: int) -> DataFrame:
    piece = lambda x: F.concat(F.lit(START), x["mark"], F.lit(SEP), x["body"], F.lit(END))
    spans = "array<struct<start:bigint,end:bigint>>"
    marked = F.transform("parts", lambda x, i: F.struct(
        (F.length(x["mark"]) + len(START) + len(SEP)).alias("lead"), F.length(x["body"]).alias("body"),
        ((i >= F.col("repeated")) & (x["role"] == "assistant") & (x["body"] != "")).alias("loss"),
    ))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["lead"]
        own = F.array(F.struct(begin.alias("start"), (begin + x["body"]).alias("end")))
        return F.struct(
            (begin + x["body"] + len(END)).alias("at"), F.when(x["loss"], F.concat(a["loss"], own)).otherwise(a["loss"]).alias("loss")
        )

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(spans).alias("loss"))
    tokens = F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"])
    return parts.select(
        "conv_id", "first", F.array_join(F.transform("parts", piece), "").alias("text"),
        F.aggregate(marked, zero, step, lambda a: a["loss"]).alias("loss"), tokens.alias("tokens"), "repeated",
        (tokens > budget).alias("over_budget"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text, in order), loss (text under the masks, unescaped) and chars, read
    from the texts, masks and repeat counts of ``windows`` alone."""
    pieces = F.split("text", END.replace("|", r"\|"))
    new = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))
    sides = lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), SEP.replace("|", r"\|"), 2)
    turns = F.transform(new, lambda p: F.struct(unescaped(sides(p)[0]).alias("role"), unescaped(sides(p)[1]).alias("text")))
    under = F.transform("loss", lambda s: unescaped(F.substr("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    read = formatted.select("conv_id", F.struct(
        "first", turns.alias("turns"), F.array_join(under, "").alias("loss"), F.length("text").alias("chars")
    ).alias("w"))
    return read.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w")).select(
        "conv_id", F.flatten(F.col("w.turns")).alias("turns"), F.array_join("w.loss", "").alias("loss"),
        F.aggregate("w.chars", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("chars"),
    )
