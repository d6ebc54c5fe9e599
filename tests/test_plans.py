import json

import pytest
from pyspark.sql import functions as F

from chronoscribe import schema as S
from chronoscribe.params import Params
from chronoscribe.plans import complete, retrieve, summarize
from chronoscribe.plans.complete import Completion, CompletionError, ai_map
from chronoscribe.plans.prompts import Templates
from chronoscribe.sources import tables
from chronoscribe.sources.folders import Pending
from chronoscribe.streaming import chunks as stream_chunks
from helpers import at, captures


def test_retry_rules():
    waits, calls = [], []

    def flaky(errors):
        left = list(errors)

        def fn(*args):
            calls.append(args)
            if left:
                raise left.pop(0)
            return Completion("ok")
        return fn

    call = lambda errors: complete.call_with_retry(flaky(errors), "p", "m", 9, "s", 3, waits.append)
    assert call([CompletionError(429, retry_after=7), CompletionError(503)]).text == "ok"
    assert waits == [7, 2.0] and calls[0] == ([{"role": "user", "content": "p"}], "m", 9, "s", 0.0)
    with pytest.raises(CompletionError):
        call([CompletionError(400)])
    with pytest.raises(CompletionError):
        call([CompletionError(500)] * 3)


def model(messages, name, max_tokens, system, temperature):
    body = messages[0]["content"]
    if "boom" in body:
        raise CompletionError(400, "boom")
    if body.startswith("Prompt:") and "Summaries:" in body:
        if "nothing" in body:
            return Completion("[]", 1, 1)
        return Completion('```json\n[{"id": 1}, {"id": 77}]\n```', 10, 2)
    if body.startswith("Query:"):
        return Completion(json.dumps([{"relevant_text": "r", "relevance_explanation": "e"}]), 5, 1)
    if body.startswith("Prompt:"):
        return Completion(f"[^1]: {body.count('--- Keyframe')} screens", 5, 1)
    return Completion(json.dumps({"summary": f"S{len(body)}", "key_topics": ["k"]}), 11, 3)


def test_ai_map_reports_errors_per_row(spark):
    df = spark.createDataFrame([(1, "x"), (2, "boom"), (3, None)], "id long, prompt string").withColumn("ts", F.current_timestamp())
    got = complete.ai_map(df, "prompt", model)
    rows = {r.id: r for r in got.collect()}
    assert rows[1].error is None and rows[1].inputTokens == 11
    assert "boom" in rows[2].error and rows[2].reply is None and rows[3].error == "no prompt"
    usage = complete.usage_from_responses(got, "c", "m").collect()
    assert [(u.id, u.caller, u.model, u.inputTokens, u.outputTokens) for u in usage] == [(1, "c", "m", 11, 3)]


def test_summary_prompt_text(spark):
    df = captures(spark, [dict(id=1, t=0, text="hello"), dict(id=2, t=90, type="delta", text="bye", change=0.256)])
    row = summarize.summary_prompts(df, ["device"]).first()
    assert row.prompt == ("Period: 00:00:00 - 00:01:30 (1m 30s)\nApplication: A\nWindow: Unknown\n\n"
                          "--- Keyframe (00:00:00) [A — Unknown] ---\nhello\n\n--- Delta (00:01:30) [25% changed] ---\nbye")


def test_progressive_rounds(spark, tmp_path):
    rows = [dict(id=i, t=i * 100, text="boom" if i == 4 else f"t{i}", app="AB"[i // 3 % 2]) for i in range(9)]
    df = captures(spark, rows).withColumn("appBundleID", F.lit(None).cast("string")).withColumn(
        "visibleWindows", F.lit(None).cast(S.WINDOWS)).select(*S.CAPTURES.names)
    paths = [str(tmp_path / n) for n in ("c", "s", "u")]
    tables.append_captures(df, paths[0])
    go = lambda now: stream_chunks.summarize_pending(spark, *paths, now, model)
    failed = go(at(1100)).collect()          # only rows older than 300 s wait: t <= 800
    assert [r.captureIds for r in failed] == [[3, 4, 5]]
    first = tables.read_summaries(spark, paths[1]).collect()
    assert sorted(tuple(r.captureIds) for r in first) == [(0, 1, 2), (6, 7, 8)]
    assert len(go(at(1100)).collect()) == 1  # the failed chunk is tried again, the others are not
    assert tables.read_summaries(spark, paths[1]).count() == 2
    usage = tables.read_token_usage(spark, paths[2])
    assert usage.agg(F.sum("inputTokens")).first()[0] == 22


def test_settled_days_are_not_read(spark, tmp_path):
    """Files of settled days are made unreadable; the next round does not notice. Late captures open their day again."""
    rows = [dict(id=i, t=i * 43_200, text=f"t{i}", app="A") for i in range(6)]  # two a day
    table = lambda rows: captures(spark, rows).withColumn("appBundleID", F.lit(None).cast("string")).withColumn(
        "visibleWindows", F.lit(None).cast(S.WINDOWS)).select(*S.CAPTURES.names)
    paths, pending, ledger = [str(tmp_path / n) for n in ("c", "s", "u")], str(tmp_path / "pending"), str(tmp_path / "ledger")
    tables.append_captures(table(rows), paths[0], pending)
    marks = Pending(spark, pending)
    assert sorted(marks.markers()) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    go = lambda now: stream_chunks.summarize_pending(spark, *paths, now, model, pending=pending, ledger=ledger).collect()
    assert go(at(2 * 86_400 + 400)) == []
    # The last capture is still to come of age, so its day stays open.
    assert marks.low_water() == "2024-01-03" and sorted(c for r in tables.read_summaries(spark, paths[1]).collect() for c in r.captureIds) == [0, 1, 2, 3, 4]
    kept = {}
    for f in (tmp_path / "c").rglob("*.parquet"):
        if "2024-01-03" not in str(f):
            kept[f] = f.read_bytes()
            f.write_bytes(b"no parquet")
    assert go(at(2 * 86_400 + 43_200 + 400)) == [] and marks.markers() == {}
    assert sorted(c for r in tables.read_summaries(spark, paths[1]).collect() for c in r.captureIds) == list(range(6))
    assert go(at(5 * 86_400)) == []
    for f, data in kept.items():
        f.write_bytes(data)
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    tables.append_captures(table([dict(id=77, t=100, text="late", app="A")]), paths[0], pending)
    assert sorted(marks.markers()) == ["2024-01-01"]
    assert go(at(5 * 86_400)) == [] and marks.markers() == {}
    assert sorted(c for r in tables.read_summaries(spark, paths[1]).collect() for c in r.captureIds) == [0, 1, 2, 3, 4, 5, 77]


def test_rows_that_come_during_a_round_keep_their_day_open(spark, tmp_path):
    marks = Pending(spark, str(tmp_path / "p"))
    marks.open(["2024-01-01", "2024-01-02"])
    seen = marks.markers()
    marks.open(["2024-01-01"])
    marks.settle(seen)
    assert list(marks.markers()) == ["2024-01-01"] and len(marks.markers()["2024-01-01"]) == 1


def test_ledger_repeats_no_call(spark, tmp_path):
    """The task's worker dies after half of its rows; the second run calls for the other half only."""
    calls, stop = tmp_path / "calls", tmp_path / "stop"
    calls.mkdir()
    stop.touch()

    def paid(messages, model_, max_tokens, system, temperature):
        import os
        text = messages[0]["content"]
        if len(os.listdir(calls)) >= 10 and stop.exists():
            os._exit(1)
        (calls / f"{text}-{len(os.listdir(calls))}").touch()
        return Completion(f"re {text}", 1, 2)

    df = spark.createDataFrame([(f"p{i}",) for i in range(20)], "prompt string").coalesce(1)
    ledger = str(tmp_path / "ledger")
    with pytest.raises(Exception):
        ai_map(df, "prompt", paid, threads=1, ledger=ledger)
    assert len(list(calls.iterdir())) == 10
    stop.unlink()
    rows = ai_map(df, "prompt", paid, threads=1, ledger=ledger).collect()
    assert {r.prompt: (r.reply, r.inputTokens, r.outputTokens, r.error) for r in rows} == {f"p{i}": (f"re p{i}", 1, 2, None) for i in range(20)}
    assert len(list(calls.iterdir())) == 20
    # Another model, or other settings, ask anew; failures are not kept.
    ai_map(df.limit(1), "prompt", paid, "other", threads=1, ledger=ledger).collect()
    assert len(list(calls.iterdir())) == 21


def test_summarize_stream(spark, tmp_path):
    df = captures(spark, [dict(id=1, t=0)])
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    q = stream_chunks.summarize_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")),
                                       lambda batch, epoch: seen.append(batch.count()), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(120)
    assert seen == [1]


@pytest.fixture(scope="module")
def world(spark):
    c = captures(spark, [dict(id=i, t=i * 60, text=f"screen {'apple' if i % 2 else 'pear'} {i}", done=i < 6) for i in range(12)])
    s = spark.createDataFrame(
        [(1, at(0), at(170), ["A"], "apple notes", ["fruit"], [0, 1, 2]), (2, at(180), at(350), ["A", "B"], "pear mail", ["mail"], [3, 4, 5])],
        "id long, startTs timestamp, endTs timestamp, appNames array<string>, summary string, keyTopics array<string>, captureIds array<long>")
    p = spark.createDataFrame([(1, "apple"), (2, "nothing here"), (3, "  ")], "prompt_id long, text string")
    return p, c, s


def test_candidates(spark, world):
    p, c, s = world
    got = retrieve.candidate_summaries(p.filter("prompt_id < 3"), s, at(200), at(400), 4)
    assert {(r.prompt_id, r.id, r.priority) for r in got.collect()} == {(1, 1, 0), (1, 2, 1), (2, 2, 1)}
    listing = {r.prompt_id: (r.listing, r.ids) for r in retrieve.summary_listing_text(got, s).collect()}
    assert listing[1] == ("[1]: 00:00:00 - 00:02:50\nApps: A\nTopics: fruit\nSummary: apple notes\n\n"
                          "[2]: 00:03:00 - 00:05:50\nApps: A, B\nTopics: mail\nSummary: pear mail", [1, 2])
    b = retrieve.unsummarized_candidates(p.filter("prompt_id = 1"), c, at(0), at(480), 8)
    # Of the four best hits (1 3 5 7) only 7 is not covered; 8, 7, 6 are the latest of the range.
    assert {(r.id, r.priority) for r in b.collect()} == {(7, 0), (8, 1), (6, 1)}


def test_enrich(spark, world):
    p, c, s = world
    got = {r.prompt_id: r for r in retrieve.enrich(p, c, s, at(0), at(100), model).collect()}
    assert set(got) == {1, 2}
    # Path A gives 0, 1, 2; path B the uncovered hits 7, 9, 11.
    assert got[1].enrichedPrompt == "apple\n\n---\n## Context References\n\n[^1]: 6 screens"
    assert (got[1].captures_examined, got[1].summaries_searched, got[1].error) == (6, 1, None)
    assert got[2].enrichedPrompt == "nothing here\n\n_(No relevant context found from recent activity.)_"


def test_citations(spark, world):
    p, c, s = world
    got = {r.prompt_id: r for r in retrieve.query_citations(p.filter("prompt_id < 3"), c, s, at(0), at(100), at(0), model, Params(), Templates()).collect()}
    assert [x.relevant_text for x in got[1].citations] == ["r"] and got[1].citations[0].timestamp == "2024-01-01T00:00:00Z"
    assert got[2].citations == []
    assert set(retrieve.STRATEGIES) == {"two_pass", "citations"}
