"""Preference formatting of paired conversations.  DataFrame functions only.

A pair is a chosen and a rejected conversation (arrays of role and text).  Their longest
common turn prefix is rendered once as the prompt; what is left of each is a completion.
Loss is masked to what the assistant says: mask holds the code-point spans of the completion that
are learned (text and end mark of assistant turns, their header left out), end exclusive.

Two kinds of pairs are derived from plain conversations.  `reply`: a conversation against
its branch in which, from a turn chosen by hash on, each reply repeats the reply before it.
`neighbour`: two conversations that open with the same turn; those are dealt into buckets of about
BUCKET by hash and paired with the next of their bucket, so no group is expanded into all
pairs or meets in one task.  Conversations with fewer than two replies have no branch: their row has
kind `single_reply` or `no_reply`, both sides equal, so that all is prompt.

Defined results: a null role or text counts as empty; equal conversations have empty
completions; a null or empty conversation shares nothing, so the other is all
completion; repeated turns of a conversation count once; ties of turn numbers
go by role, then text; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import materialise

#: how a turn is written.
TURN = "<|{role}|>\n{text}<|end|>\n"
#: conversations of one bucket, about.
BUCKET = 256


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (role, text) in order, from rows conv_id, turn, role, text."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _hash(c: Column, width: int = 4) -> Column:
    """A number from the first hex digits of a string's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, width), 16, 10).cast("int")


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, kind, other_id (the same), chosen, rejected: one row for each conversation."""
    told = turns_of(conversations).withColumn(
        "replies", F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == "assistant", i)), lambda i: i.isNotNull())
    )
    n = F.size("replies")
    told = told.withColumn("from", F.when(n > 1, F.get("replies", 1 + F.pmod(_hash(F.col("conv_id")), n - 1))))
    branch = F.transform("turns", lambda x, i: F.when(
        (x["role"] == "assistant") & (i >= F.col("from")),
        F.struct(x["role"].alias("role"), F.get("turns", F.element_at(F.filter("replies", lambda k: k < i), -1))["text"].alias("text")),
    ).otherwise(x))
    return told.select(
        "conv_id", F.when(n > 1, "reply").when(n == 1, "single_reply").otherwise("no_reply").alias("kind"), F.col("conv_id").alias("other_id"),
        F.col("turns").alias("chosen"), F.when(n > 1, branch).otherwise(F.col("turns")).alias("rejected"),
    )


def neighbour_pairs(conversations: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """conv_id, kind, other_id, chosen, rejected: conversations with an equal first turn, each against the next
    of its bucket in the order of their ids' hashes; the longer of two (ties: the first) is chosen."""
    told = turns_of(conversations).where("conv_id IS NOT NULL").withColumn("first", F.md5(F.concat_ws("\n", F.get("turns", F.lit(0))["role"], F.get("turns", F.lit(0))["text"])))
    # written first, so that the join with a first turn that many share can be split
    sizes = materialise(told.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "first-turns")
    dealt = told.join(sizes, "first").withColumn("bucket", F.pmod(_hash(F.col("conv_id"), 7), F.ceil(F.col("n") / bucket)))
    order = Window.partitionBy("first", "bucket").orderBy(F.md5(F.col("conv_id").cast("string")))
    met = dealt.select("conv_id", "turns", F.lead("conv_id").over(order).alias("next_id"), F.lead("turns").over(order).alias("next")).where("next_id IS NOT NULL")
    swap = F.size("next") > F.size("turns")
    either = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return met.select(
        either("conv_id", "next_id").alias("conv_id"), F.lit("neighbour").alias("kind"), either("next_id", "conv_id").alias("other_id"),
        either("turns", "next").alias("chosen"), either("next", "turns").alias("rejected"),
    )


def preference_pairs(conversations: DataFrame) -> DataFrame:
    return reply_pairs(conversations).unionByName(neighbour_pairs(conversations))


def _render(turn: Column) -> Column:
    head, rest = TURN.split("{role}")
    middle, tail = rest.split("{text}")
    return F.concat(F.lit(head), turn["role"], F.lit(middle), turn["text"], F.lit(tail))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """Spans of assistant turns without their headers in the rendered turns, as start:end, comma-joined."""
    header = len(TURN.split("{text}")[0].replace("{role}", "assistant"))
    step = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(_render(x))).alias("at"),
            F.when(
                x["role"] == "assistant",
                F.concat(acc["spans"], F.array(F.concat_ws(":", (acc["at"] + header).cast("string"), (acc["at"] + F.length(_render(x))).cast("string")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return F.array_join(step["spans"], ",")


def format_pairs(pairs: DataFrame, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """keys, n_shared (turns of the prompt), prompt, chosen, rejected, chosen_mask, rejected_mask."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = pairs.select(*keys, F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    differ = F.array_position(F.zip_with("c", "r", lambda x, y: x.eqNullSafe(y)), False)
    shared = F.when(differ > 0, differ - 1).otherwise(F.least(F.size("c"), F.size("r"))).cast("int")
    cut = both.withColumn("n_shared", shared)
    rest = {k: F.slice(k, F.col("n_shared") + 1, F.size(k)) for k in ("c", "r")}
    cut = cut.select(*keys, "n_shared", F.slice("c", F.lit(1), F.col("n_shared")).alias("p"), *[
        F.when(F.size(k) > F.col("n_shared"), v).otherwise(none).alias(k) for k, v in rest.items()
    ])
    return cut.select(
        *keys, "n_shared", _text(F.col("p")).alias("prompt"), _text(F.col("c")).alias("chosen"), _text(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"),
    )
