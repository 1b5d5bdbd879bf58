"""Transcripts with tool messages."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from logloom.operators import transcripts as tr

DDL = "conv_id string, turn int, role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string, tool_name string"
HEAD = "[CONVERSATION HISTORY SUMMARY]\nEarlier investigation steps were summarized to save context:\n"


def conversation(cid, exchanges, system=True):
    rows = [(cid, 0, "system" if system else "user", "be useful", None, None, None), (cid, 1, "user", "look", None, None, None)]
    for i in range(exchanges):
        n = len(rows)
        rows.append((cid, n, "assistant", f"think {i}" if i % 2 == 0 else "", [(f"c{i}", "metrics", "{}")], None, None))
        rows.append((cid, n + 1, "tool", "r" * 200 if i == 0 else f"result {i}", None, f"c{i}", "metrics"))
    return rows


def test_compaction(spark):
    df = spark.createDataFrame(conversation("long", 4) + conversation("short", 2) + [("one", 0, "system", "s", None, None, None), ("one", 1, "assistant", "hi", None, None, None)], DDL)
    rows = tr.compact(df).orderBy("conv_id", "turn", "seq").collect()
    long = [r for r in rows if r.conv_id == "long"]
    assert [(r.turn, r.seq, r.role) for r in long] == [(0, 0, "system"), (0, 1, "user"), (6, 0, "assistant"), (7, 0, "tool"), (8, 0, "assistant"), (9, 0, "tool")]
    first = "Assistant: think 0; Called tool \"metrics\"; Tool \"metrics\" result: " + "r" * 150 + "..."
    second = "Called tool \"metrics\"; Tool \"metrics\" result: result 1"
    assert long[1].content == f"{HEAD}- {first}\n- {second}\n"
    assert all(r.compacted for r in long)
    assert [r.turn for r in rows if r.conv_id == "short"] == list(range(6)) and not any(r.compacted for r in rows if r.conv_id == "short")
    assert len([r for r in rows if r.conv_id == "one"]) == 2


def test_compaction_needs_to_shrink(spark):
    """Three bare assistant messages: replacing one message by one summary would not help."""
    rows = [("c", 0, "system", "s", None, None, None)] + [("c", i, "assistant", f"a{i}", None, None, None) for i in (1, 2, 3)]
    out = tr.compact(spark.createDataFrame(rows, DDL)).collect()
    assert len(out) == 4 and not any(r.compacted for r in out)


def test_exchange_numbers_of_an_endless_conversation(spark):
    """One conversation that spans many blocks."""
    rnd = random.Random(5)
    rows = [("c", i, rnd.choice(["user", "assistant", "tool"])) for i in range(9000)]
    want, n = {}, 0
    for _, i, role in rows:
        n += role == "assistant" and i > 0
        want[i] = n
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string").withColumn("content", F.lit("x"))
    got = {r.turn: r.exchange_no for r in tr.numbered_messages(df).collect()}
    assert got == want
    assert tr.group_exchanges(df).count() == sum(v > 0 for v in want.values())


def test_answers_and_tools(spark):
    rows = conversation("c", 2) + [("c", 6, "assistant", '```json\n{"severity":"critical","summary":"s","detail":"d"}\n```', None, None, None)]
    df = spark.createDataFrame(rows, DDL)
    a = tr.final_answers(df).first()
    assert (a.turn, a.severity, a.summary, a.detail) == (6, "critical", "s", "d")
    it = tr.iterations(df, 3).first()
    assert (it.iterations, it.limit_reached) == (3, True)
    calls = tr.tool_calls(df)
    assert calls.count() == 2
    registry = spark.createDataFrame([("logs",)], "tool_name string")
    assert tr.unknown_tools(calls, registry).count() == 2
    assert tr.datasources_used(df).first().datasources == ["metrics"]
    cut = tr.truncate_results(df, 100).filter("turn = 3").first().content
    assert cut.startswith("r" * 100 + "\n\n[TRUNCATED: original 200 chars")
    errors = spark.createDataFrame([("m", "timeout"), ("m", "timeout"), ("m", None)], "tool_name string, error string")
    assert [tuple(r) for r in tr.tool_errors(errors).collect()] == [("m", "connection", 2)]
