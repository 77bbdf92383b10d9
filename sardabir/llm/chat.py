"""Operator 3: chat formatting by Spark expressions only.

The template, for each run of adjacent turns of one role::

    <s>ROLE[INST]TEXT[/INST][INST]TEXT[/INST]</s>

The four control strings are escaped inside roles and texts by one more backslash after their opening bracket, as in
``[\\INST]``; an escaped form that stands in a text itself gets one more. So a formatted conversation can be read back
to the same turns, whatever they say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE_OPEN, RUN_CLOSE, TURN_OPEN, TURN_CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
#: A control string with any number of backslashes after its opening bracket.
ESCAPABLE = r"(<|\[)(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"(<|\[)\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPABLE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, ``formatted`` and ``parts``.

    ``parts`` is an array of (text, loss); its texts joined are ``formatted``, and those with ``loss`` are the mask.
    Every step is linear in the conversation's length: runs of a role are found by their first positions and cut out by
    ``slice``, and strings are joined once. A conversation becomes one string and so has to fit a row (2 GB).

    Null text or role: empty. Null turn: last. Ties of turn: by role, then text. Repeated rows: repeated turns. Null
    conv_id: a conversation of its own. Other columns are not read.
    """
    rows = turns.select("conv_id", F.struct(
        F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"))
    told = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    first = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at(F.col("turns"), i)["role"] != F.element_at(F.col("turns"), F.greatest(i - 1, F.lit(1)))["role"]))
    told = told.withColumn("first", first)
    run = lambda at, k: F.slice(F.col("turns"), at, F.coalesce(F.get(F.col("first"), k + 1), F.size("turns") + 1) - at)
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def formatted_run(at: Column, k: Column) -> Column:
        role = F.element_at(F.col("turns"), at)["role"]
        bodies = F.flatten(F.transform(run(at, k), lambda t: F.array(
            part(F.lit(TURN_OPEN), F.lit(False)), part(escape(t["text"]), role.isin(*loss_roles)), part(F.lit(TURN_CLOSE), F.lit(False)))))
        return F.concat(F.array(part(F.concat(F.lit(ROLE_OPEN), escape(role)), F.lit(False))), bodies, F.array(part(F.lit(RUN_CLOSE), F.lit(False))))

    return told.select("conv_id", F.flatten(F.transform("first", formatted_run)).alias("parts")).select(
        "conv_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"), "parts")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, parsed from the string alone."""
    runs = F.slice(F.split(formatted, F.lit(r"\Q</s>\E"), -1), F.lit(1), F.size(F.split(formatted, F.lit(r"\Q</s>\E"), -1)) - 1)

    def parse(run: Column) -> Column:
        role = unescape(F.substring_index(F.substr(run, F.lit(len(ROLE_OPEN) + 1)), TURN_OPEN, 1))
        bodies = F.split(run, F.lit(r"\Q[INST]\E"), -1)
        return F.transform(F.slice(bodies, F.lit(2), F.size(bodies) - 1), lambda b: F.struct(
            role.alias("role"), unescape(F.left(b, F.length(b) - len(TURN_CLOSE))).alias("text")))

    return F.flatten(F.transform(runs, parse))


def masked_text(parts: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")
