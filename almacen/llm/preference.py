"""6. Preference formatting of chosen and rejected conversations (native: SQL functions only).

The longest common prefix of turns is rendered once as the prompt; what
follows in either conversation is its completion. A completion carries the
spans (code points, end exclusive) that are trained on: the bodies and end
marks of the trained role, never a header or another role's turn.

Defined cases: null roles or texts count as empty; turns sort by number, then
role and text; repeated rows are one turn; equal conversations give a whole
prompt and two empty completions; an empty table gives no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

END = "\n<|end|>\n"


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation as an ordered array of ``(role, text)``."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                   F.coalesce("text", F.lit("")).alias("text"))
    return (conversations.groupBy("conv_id").agg(F.sort_array(F.collect_set(row)).alias("t"))
            .select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"),
                                                                   t["text"].alias("text"))).alias("turns")))


def stale_answers(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: ``pair_id, chosen, rejected``.

    Chosen is the conversation up to its last assistant turn. Rejected has
    the same turns, but the last answer is a stale one: the conversation's
    first assistant turn, or, where that is the only one, the text it should
    have answered. A conversation without an assistant turn is paired with itself.
    """
    t = turns(conversations)
    answers = F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == "assistant", i)),
                       lambda i: i.isNotNull())
    t = t.withColumn("at", answers)
    last, first = F.element_at("at", -1), F.element_at("at", 1)
    stale = F.when(first < last, F.get("turns", first)["text"]).otherwise(
        F.coalesce(F.get("turns", last - 1)["text"], F.lit("")))
    chosen = F.slice("turns", F.lit(1), last + 1)
    rejected = F.concat(F.slice("turns", F.lit(1), last),
                        F.array(F.struct(F.lit("assistant").alias("role"), stale.alias("text"))))
    none = F.size("at") == 0
    return t.select(F.col("conv_id").alias("pair_id"),
                    F.when(none, F.col("turns")).otherwise(chosen).alias("chosen"),
                    F.when(none, F.col("turns")).otherwise(rejected).alias("rejected"))


def _header(t) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def _render(ts: Column) -> Column:
    return F.array_join(F.transform(ts, lambda t: F.concat(_header(t), t["text"], F.lit(END))), "")


def _mask(ts: Column, role: str) -> Column:
    """Spans of the trained turns within the rendered ``ts``."""
    start = F.struct(F.lit(0).cast("long").alias("at"),
                     F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.char_length(_header(t))
        stop = begin + F.char_length(t["text"]) + F.lit(len(END))
        span = F.struct(begin.cast("long").alias("start"), stop.cast("long").alias("stop"))
        return F.struct(stop.cast("long").alias("at"),
                        F.when(t["role"] == role, F.concat(acc["spans"], F.array(span)))
                        .otherwise(acc["spans"]).alias("spans"))
    return F.aggregate(ts, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, role: str = "assistant") -> DataFrame:
    """``pair_id, prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans`` of
    ``pairs(pair_id, chosen, rejected)`` with arrays of ``(role, text)``."""
    both = F.least(F.size("chosen"), F.size("rejected"))

    def equal_turns(n):
        same = F.zip_with(F.slice("chosen", F.lit(1), n), F.slice("rejected", F.lit(1), n),
                          lambda a, b: a.eqNullSafe(b))
        return let(F.array_position(same, False), lambda p: F.when(p == 0, n.cast("long")).otherwise(p - 1))
    p = pairs.withColumn("prompt_turns", let(both, equal_turns))
    rest = {c: F.slice(c, F.col("prompt_turns").cast("int") + 1, F.size(c)) for c in ("chosen", "rejected")}
    p = p.select("pair_id", "prompt_turns", F.slice("chosen", F.lit(1), F.col("prompt_turns").cast("int")).alias("p"),
                 rest["chosen"].alias("c"), rest["rejected"].alias("r"))
    return p.select("pair_id", "prompt_turns", _render(F.col("p")).alias("prompt"),
                    _render(F.col("c")).alias("chosen"), _mask(F.col("c"), role).alias("chosen_spans"),
                    _render(F.col("r")).alias("rejected"), _mask(F.col("r"), role).alias("rejected_spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
