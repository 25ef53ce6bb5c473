r"""Chat formatting with Spark expressions only.

A conversation becomes one string:

    <|start|>ROLE<|text|>TEXT<|next|>TEXT<|end|> ...

with one message for each run of adjacent turns of the same role, whose texts
<|next|> keeps apart. Inside roles and texts every backslash becomes \s and every
<| becomes \l| so no control string can occur there and each is told back. The
loss mask is a list of spans (start, length in UTF-8 bytes): each text of the
assistant, without marks.

A conversation is one value of the result and so is gathered by one task;
that bounds a conversation to what one string holds (2 GB). Time grows with a
conversation's length: spans come from running totals along its pieces.

Defined cases: null text or role counts as empty; rows of one conversation
sort by turn (null first), then role, then text, so repeated rows and ties are
kept and give the same string each time; a null conv_id is a conversation of
its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.arrays import bound, running_sum

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
BACKSLASH = "\\"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(BACKSLASH), F.lit("\\s")), F.lit("<|"), F.lit("\\l|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit(BACKSLASH))


def merged(turns: Column) -> Column:
    """Messages struct(role, texts) from turns sorted: one for each run of a role."""
    starts = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: (i == 1) | (F.get(turns, i - 1)["role"] != F.get(turns, i - 2)["role"]))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(turns) + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(turns, a - 1)["role"].alias("role"), F.transform(F.slice(turns, a, b - a), lambda t: t["text"]).alias("texts")))


def piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def formatted(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted string, loss_mask array<struct<start, length>> (0-based, UTF-8 bytes)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).withColumn("messages", merged(F.col("turns")))
    mark = lambda s: piece(F.lit(s) if isinstance(s, str) else s, F.lit(False))

    def pieces(m: Column) -> Column:
        texts = F.transform(m["texts"], lambda t, i: F.array(mark(F.when(i > 0, NEXT).otherwise("")), piece(escaped(t), m["role"] == learn)))
        return F.concat(F.array(mark(F.concat(F.lit(START), escaped(m["role"]), F.lit(TEXT)))), F.flatten(texts), F.array(mark(END)))

    convs = convs.withColumn("pieces", F.flatten(F.transform("messages", pieces)))
    convs = convs.withColumn("lengths", F.transform("pieces", lambda p: F.octet_length(p["text"]).cast("long")))
    span = lambda p, end: F.struct((end - F.octet_length(p["text"])).alias("start"), F.octet_length(p["text"]).cast("long").alias("length"), p["loss"].alias("loss"))
    spans = F.filter(F.zip_with("pieces", running_sum(F.col("lengths")), span), lambda s: s["loss"])
    spans = F.transform(spans, lambda s: F.struct(s["start"], s["length"]))
    return convs.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), spans.alias("loss_mask"))


def read_back(df: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, loss_text, from the output of formatted() alone."""
    parts = F.split(F.col("formatted"), r"<\|end\|>", -1)

    def turns(message: Column) -> Column:
        halves = F.split(F.substring(message, len(START) + 1, 1 << 30), r"<\|text\|>", -1)
        return bound(halves, lambda h: F.transform(F.split(F.get(h, F.lit(1)), r"<\|next\|>", -1), lambda t: F.struct(unescaped(F.get(h, F.lit(0))).alias("role"), unescaped(t).alias("text"))))

    messages = bound(parts, lambda p: F.slice(p, 1, F.size(p) - 1))
    cut = lambda b, s: unescaped(F.substring(b, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))
    under = bound(F.col("formatted").cast("binary"), lambda b: F.transform("loss_mask", lambda s: cut(b, s)))
    return df.select("conv_id", F.flatten(F.transform(messages, turns)).alias("turns"), F.array_join(under, "").alias("loss_text"), "formatted")


PLANTED = "\\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(planted)
    back = read_back(formatted(rows))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(text, '\', '\s'), '<|', '\l|')) AS n_text, length(replace(replace(role, '\', '\s'), '<|', '\l|')) AS n_role,
        coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, false) AS same FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + CASE WHEN same THEN length('<|next|>') ELSE n_role + length('<|start|><|text|><|end|>') END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
