"""Chat formatting in budgeted windows.

A conversation becomes one or more windows of whole turns. Prefix sums of the turns' token counts choose the spans: a
window takes turns as long as their sum stays within what the budget leaves; every later window first repeats the
system turn and the last turns before its span, as far as ``history`` tokens go. Repeated turns are never targets: the
loss mask covers each assistant text once, in the window whose span holds its turn. A turn longer than the budget gets a
window of its own, whole.

Template: ``<|im_start|>`` role, newline, text ``<|im_end|>``, newline. In roles and texts ``~ < [`` are written as
``~0 ~1 ~2`` (in roles a newline is ``~3``), so no control string, of this template or of those that use ``</s>`` or
``[INST]``, can come from a text, and reading back is exact.

Main path: SQL functions only. A conversation is one record, read whole, as its digests are over all its turns.

Defined cases: null texts and roles count as empty; turns are ordered by (turn, role, text), nulls first, so ties and
repeated rows have a fixed order and all stay; rows with a null conv_id form one conversation; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Written form of the characters that control strings begin with; ``~`` first when writing, last when reading.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def turn_tokens(text: Column) -> Column:
    """Tokens that a turn is counted as: its words and, for long words, one more for every four characters; two for the marks."""
    return (F.char_length(text) / 4).cast("int") + F.regexp_count(text, F.lit(r"\S+")) + 2


def windows(rows: DataFrame, budget: int = 768, history: int = 192) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_context (turns that are repeated), mask (array of start, length in characters)."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    turn = F.struct("turn", role.alias("role"), text.alias("text"), turn_tokens(text).alias("n"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn), _order).alias("t"))
    # sums[i]: tokens of the turns up to i, so a span's tokens are a difference
    sums = F.aggregate("t", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x["n"])))
    out = turns.select("conv_id", "t", sums.alias("sums"), _system("t").alias("sys"))
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce(F.get("t", F.col("sys"))["n"], F.lit(0)))
    # starts: positions of the first new turn of each window
    starts = F.aggregate(
        F.sequence(F.lit(1), F.size("t")),
        F.array(F.lit(0)),
        lambda s, i: F.when(
            (i > F.element_at(s, -1) + 1) & (F.get("sums", i) - F.get("sums", F.element_at(s, -1)) > room), F.concat(s, F.array(i - 1))
        ).otherwise(s),
    )
    out = out.withColumn("starts", starts).select("conv_id", "t", "sums", "sys", "starts", F.posexplode("starts").alias("window", "a"))
    out = out.withColumn("b", F.coalesce(F.get("starts", F.col("window") + 1), F.size("t")))
    # the history begins at the first turn from which no more than ``history`` tokens lead to the span
    back = F.size(F.filter("sums", lambda s, i: (i < F.col("a")) & (F.get("sums", F.col("a")) - s > history)))
    out = out.withColumn("h", F.when(F.col("window") == 0, F.col("a")).otherwise(back))
    kept_system = F.when((F.col("sys") >= 0) & (F.col("sys") < F.col("h")), F.slice("t", F.col("sys") + 1, F.lit(1))).otherwise(F.slice("t", 1, 0))
    out = out.withColumn("context", F.concat(kept_system, F.expr("slice(t, h + 1, a - h)"))).withColumn("new", F.expr("slice(t, a + 1, b - a)"))
    head = lambda x: F.concat(F.lit(START), F.replace(escape(x["role"]), F.lit("\n"), F.lit("~3")), F.lit("\n"))
    piece = F.transform(F.concat("context", "new"), lambda x: F.struct(x["role"].alias("role"), head(x).alias("head"), escape(x["text"]).alias("text")))
    out = out.select("conv_id", "window", F.size("context").alias("n_context"), piece.alias("p"))
    formatted = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["text"], F.lit(END))), "")
    begin = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start: int, length: int>>)").alias("mask"), F.lit(0).alias("i"))
    step = lambda s, x: F.struct(
        (s["at"] + F.char_length(x["head"]) + F.char_length(x["text"]) + len(END)).alias("at"),
        F.when(
            (x["role"] == "assistant") & (s["i"] >= F.col("n_context")),
            F.concat(s["mask"], F.array(F.struct((s["at"] + F.char_length(x["head"])).alias("start"), F.char_length(x["text"]).alias("length")))),
        )
        .otherwise(s["mask"])
        .alias("mask"),
        (s["i"] + 1).alias("i"),
    )
    mask = F.aggregate("p", begin, step, lambda s: s["mask"])
    return out.select("conv_id", "window", "n_context", formatted.alias("formatted"), mask.alias("mask"))


def _order(x: Column, y: Column) -> Column:
    """By turn, role, text; nulls first."""
    out = F.lit(0)
    for k in ("text", "role", "turn"):
        a, b = x[k], y[k]
        out = (
            F.when(a.isNull() & b.isNotNull(), -1).when(a.isNotNull() & b.isNull(), 1).when(a < b, -1).when(a > b, 1).otherwise(out)
        )
    return out


def _system(turns: str) -> Column:
    """Position of the first system turn, else -1."""
    return F.array_position(F.transform(turns, lambda x: x["role"]), "system").cast("int") - 1


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation from ``windows``' output alone: conv_id, n_turns, turns (role, text), targets, formatted_chars."""
    parts = F.expr("slice(parts, n_context + 1, size(parts) - n_context - 1)")
    one = F.transform(
        parts,
        lambda x: F.struct(
            unescape(F.replace(F.substring_index(F.substring(x, len(START) + 1, 1 << 30), "\n", 1), F.lit("~3"), F.lit("\n"))).alias("role"),
            unescape(F.substring(x, F.instr(x, F.lit("\n")) + 1, F.lit(1 << 30))).alias("text"),
        ),
    )
    rows = formatted.withColumn("parts", F.split("formatted", r"<\|im_end\|>\n")).select(
        "conv_id",
        "window",
        one.alias("turns"),
        F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))).alias("targets"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    by = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return by.select("conv_id", F.flatten(F.col("w")["turns"]).alias("turns"), F.flatten(F.col("w")["targets"]).alias("targets"), "formatted_chars")


def digest(turns: DataFrame) -> DataFrame:
    """The digests of ``read_back``'s rows."""
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    targets = F.array_join("targets", "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(targets).cast("long").alias("loss_chars"),
        F.sha2(targets, 256).alias("loss_sha256"),
        "formatted_chars",
    )
