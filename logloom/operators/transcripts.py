"""Conversation tables of analysis runs: exchanges, summaries, compaction, answers, tool use.

Tables have conv_id, turn, role, content and, when tools were used, tool_calls, tool_call_id, tool_name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.analysis import parse_analysis, tool_error_category, truncate_tool_result
from logloom.functions.text import go_quote, truncate
from logloom.plans.blocks import blocked_running_sum
from logloom.session import materialize

ASSISTANT_BYTES, RESULT_BYTES, KEEP_EXCHANGES, TURNS_PER_BLOCK = 200, 150, 2, 4096

# fixed values: head of the message that replaces summarized exchanges
SUMMARY_HEAD = (
    "[CONVERSATION HISTORY SUMMARY]\nEarlier investigation steps were summarized to save context:\n"
)
_TOOL_CALLS = "array<struct<id:string,name:string,arguments:string>>"


def with_tool_columns(t: DataFrame) -> DataFrame:
    """Add empty tool columns where a table has none."""
    for name, kind in (("tool_calls", _TOOL_CALLS), ("tool_call_id", "string"), ("tool_name", "string")):
        if name not in t.columns:
            t = t.withColumn(name, F.lit(None).cast(kind))
    return t


def numbered_messages(t: DataFrame) -> DataFrame:
    """All messages with their exchange number, 0 before the first exchange.

    The opening message never starts an exchange. The numbering is a running sum in blocks of turns, so one
    endless conversation does not end up in one task.
    """
    opening = t.groupBy("conv_id").agg(F.min("turn").alias("_first"))
    start = ((F.col("role") == "assistant") & (F.col("turn") > F.col("_first"))).cast("bigint")
    block = F.floor(F.col("turn") / TURNS_PER_BLOCK)
    joined = t.join(opening, "conv_id")
    return blocked_running_sum(joined, ["conv_id"], block, [F.col("turn")], start, "exchange_no").drop("_first")


def group_exchanges(t: DataFrame) -> DataFrame:
    """Messages that belong to an exchange: an assistant message and what follows it."""
    return numbered_messages(t).filter("exchange_no > 0")


def message_parts(role: Column, content: Column, tool_calls: Column, tool_name: Column) -> Column:
    """Summary lines of one message."""
    text = F.coalesce(content, F.lit(""))
    said = F.when(text != "", F.array(F.concat(F.lit("Assistant: "), truncate(text, ASSISTANT_BYTES)))).otherwise(
        F.array().cast("array<string>")
    )
    called = F.transform(
        F.coalesce(tool_calls, F.array().cast(_TOOL_CALLS)), lambda c: F.concat(F.lit("Called tool "), go_quote(c["name"]))
    )
    result = F.concat(
        F.lit("Tool "), go_quote(F.coalesce(tool_name, F.lit(""))), F.lit(" result: "), truncate(text, RESULT_BYTES)
    )
    return (
        F.when(role == "assistant", F.concat(said, called))
        .when(role == "tool", F.array(result))
        .otherwise(F.array().cast("array<string>"))
    )


def summarize_exchanges(numbered: DataFrame) -> DataFrame:
    """One summary line per exchange, from the output of numbered_messages."""
    parts = message_parts(F.col("role"), F.col("content"), F.col("tool_calls"), F.col("tool_name"))
    lines = (
        numbered.filter("exchange_no > 0")
        .select("conv_id", "exchange_no", "turn", parts.alias("parts"))
        .groupBy("conv_id", "exchange_no")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "parts"))).alias("m"))
    )
    return lines.select("conv_id", "exchange_no", F.array_join(F.flatten(F.col("m.parts")), "; ").alias("summary"))


def _cuts(t: DataFrame, keep: int) -> DataFrame:
    """Conversations worth compacting, with their first turn and the turn at which the kept exchanges begin.

    Reads turns and roles only. Of every conversation just the last keep + 1 exchange starts are ranked.
    """
    opening = t.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n_messages"))
    last_first = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    tail = (
        t.filter("role = 'assistant'").select("conv_id", "turn").join(opening, "conv_id").filter("turn > first_turn")
        .withColumn("n", F.row_number().over(last_first)).filter(F.col("n") <= keep + 1)
        .groupBy("conv_id", "first_turn", "n_messages")
        .agg(F.max(F.when(F.col("n") == keep, F.col("turn"))).alias("cut_turn"), F.count("*").alias("ranked"))
        .filter((F.col("ranked") > keep) & (F.col("n_messages") > 3))
        .select("conv_id", "first_turn", "cut_turn")
    )
    dropped = (
        t.select("conv_id", "turn").join(tail, "conv_id").filter("turn < cut_turn")
        .groupBy("conv_id", "first_turn", "cut_turn").agg(F.count("*").alias("n"))
    )
    # the opening message and the summary take the place of the dropped ones
    return dropped.filter("n > 2").drop("n")


def compact(t: DataFrame, keep: int = KEEP_EXCHANGES) -> DataFrame:
    """Replace all but the last exchanges of a conversation by one summary message.

    Only conversations with more than three messages, more than `keep` exchanges, and fewer messages
    afterwards change; the others stay as they are. Order is (turn, seq).
    """
    if keep < 1:
        raise ValueError("at least one exchange has to stay")
    columns = ["conv_id", "turn", "role", "content", "tool_calls", "tool_call_id", "tool_name"]
    full = with_tool_columns(t).select(*columns)
    cuts = materialize(_cuts(full, keep), "conversation-cuts")
    messages = (
        full.join(cuts, "conv_id", "left")
        .filter("cut_turn is null or turn = first_turn or turn >= cut_turn")
        .select(*columns, F.lit(0).alias("seq"), F.col("cut_turn").isNotNull().alias("compacted"))
    )
    old = full.join(cuts, "conv_id").filter("turn < cut_turn").drop("cut_turn", "first_turn")
    lines = summarize_exchanges(numbered_messages(old))
    summaries = (
        lines.groupBy("conv_id")
        # the summary is one message by definition; each exchange adds one line to it
        .agg(F.array_sort(F.collect_list(F.struct("exchange_no", "summary"))).alias("s"))
        .join(cuts, "conv_id")
        .select(
            "conv_id",
            F.col("first_turn").alias("turn"),
            F.lit("user").alias("role"),
            F.concat(
                F.lit(SUMMARY_HEAD), F.array_join(F.transform("s.summary", lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")
            ).alias("content"),
            F.lit(None).cast(_TOOL_CALLS).alias("tool_calls"),
            F.lit(None).cast("string").alias("tool_call_id"),
            F.lit(None).cast("string").alias("tool_name"),
            F.lit(1).alias("seq"),
            F.lit(True).alias("compacted"),
        )
    )
    return messages.unionByName(summaries)


def final_answers(t: DataFrame) -> DataFrame:
    """Parsed last assistant message without tool calls of every conversation."""
    plain = with_tool_columns(t).filter((F.col("role") == "assistant") & (F.coalesce(F.size("tool_calls"), F.lit(0)) <= 0))
    last = plain.groupBy("conv_id").agg(F.max_by("content", "turn").alias("content"), F.max("turn").alias("turn"))
    return last.select("conv_id", "turn", parse_analysis(F.col("content")).alias("a")).select(
        "conv_id", "turn", "a.severity", "a.summary", "a.detail"
    )


def iterations(t: DataFrame, max_iterations: int = 10) -> DataFrame:
    """Model calls per conversation, and whether the limit was reached."""
    n = F.count_if(F.col("role") == "assistant")
    return t.groupBy("conv_id").agg(n.alias("iterations"), (n >= max_iterations).alias("limit_reached"))


def truncate_results(t: DataFrame, limit: int) -> DataFrame:
    """Tool messages cut to a byte limit."""
    return t.withColumn(
        "content", F.when(F.col("role") == "tool", truncate_tool_result(F.col("content"), limit)).otherwise(F.col("content"))
    )


def tool_errors(calls: DataFrame) -> DataFrame:
    """Failed tool calls by tool and class; calls: tool_name, error."""
    return (
        calls.filter("error is not null")
        .groupBy("tool_name", tool_error_category(F.col("error")).alias("category"))
        .agg(F.count("*").alias("errors"))
    )


def tool_calls(t: DataFrame) -> DataFrame:
    """One row per tool call."""
    return with_tool_columns(t).filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.explode("tool_calls").alias("c")
    ).select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("tool_name"), F.col("c.arguments").alias("arguments"))


def unknown_tools(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """Calls that name a tool that is not registered."""
    return calls.join(registry.select("tool_name").distinct(), "tool_name", "left_anti")


def datasources_used(t: DataFrame) -> DataFrame:
    """Names of the tools whose results a conversation holds."""
    return t.filter((F.col("role") == "tool") & F.col("tool_name").isNotNull()).groupBy("conv_id").agg(
        F.array_sort(F.collect_set("tool_name")).alias("datasources")
    )
