"""Chat formatting by event-sourced reconstruction.

An event log has conv_id, turn, seq, kind, role, text. Within a conversation events are sorted by
turn, then seq; a `message` event opens a message, `delta` appends to the turn's open message,
`edit` and `regenerate` replace its text (later deltas append again). Folded messages are rendered
as <|im_start|>role newline text <|im_end|> newline. Control strings inside texts and roles are
escaped reversibly: & as &amp;, <| as &lt;| and, in a role, newline as &nl;.

Null texts and roles are empty, a null turn sorts first, rows with equal turn and seq keep separate
messages in the order of role and text, and a null conv_id is a conversation of its own. An event
before any message opens one. Events of one conversation meet in one row, as its text does; there
is no other grouping. An empty log gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, turn, no, role, text): the final messages."""
    opens = F.col("kind") == "message"
    e = events.select("conv_id", "turn", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id", "turn").orderBy("seq", opens.desc(), "role", "text").rowsBetween(W.unboundedPreceding, 0)
    e = e.repartition("conv_id").withColumn("no", F.sum(opens.cast("int")).over(order)).withColumn("at", F.count(F.lit(1)).over(order))
    last = F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(W.partitionBy("conv_id", "turn", "no"))
    e = e.withColumn("last", F.coalesce(last, F.lit(0))).where("at >= last OR kind = 'message'")
    kept = F.sort_array(F.collect_list(F.when(F.col("at") >= F.col("last"), F.struct("at", "text"))))
    role = F.min_by("role", "at")
    return e.groupBy("conv_id", "turn", "no").agg(role.alias("role"), F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("text"))


def render(final: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): the text of a conversation and the [start, end) code point
    ranges of its assistant texts."""
    parts = final.select("conv_id", F.struct("turn", "no", F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("&nl;")).alias("role"), escaped(F.col("text")).alias("text")).alias("m"))
    log = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    formatted = F.array_join(F.transform("m", lambda x: F.concat(F.lit(OPEN), x["role"], F.lit("\n"), x["text"], F.lit(CLOSE))), "")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["role"]) + len(OPEN) + 1
        end = start + F.length(x["text"])
        mask = F.array(F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        return F.struct((end + len(CLOSE)).cast("bigint").alias("at"), F.when(x["role"] == "assistant", F.concat(acc["mask"], mask)).otherwise(acc["mask"]).alias("mask"))

    mask = F.aggregate("m", F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("mask")), step)["mask"]
    return log.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text): what the formatted text and its mask say, unescaped."""
    bodies = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda x: x != "")
    head = lambda x: F.substring_index(x, "\n", 1)
    role = lambda x: unescaped(F.replace(F.replace(head(x), F.lit(OPEN), F.lit("")), F.lit("&nl;"), F.lit("\n")))
    text = lambda x: unescaped(F.substring(x, F.length(head(x)) + 2, F.length(x)))
    turns = F.transform(bodies, lambda x: F.struct(role(x).alias("role"), text(x).alias("text")))
    loss = F.array_join(F.transform("loss_mask", lambda x: unescaped(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))), "")
    return rendered.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))
