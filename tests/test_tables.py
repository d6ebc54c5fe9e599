import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoscribe import schema as S
from chronoscribe.operators import dedup, joins, retention, scan, stats
from chronoscribe.sources import tables
from helpers import at, captures


def full(spark, rows):
    windows = F.array(F.struct(F.lit("W").alias("appName"), F.lit("t").alias("windowTitle")))
    df = captures(spark, rows).withColumn("appBundleID", F.lit(None).cast("string")).withColumn("visibleWindows", windows)
    return df.select(*S.CAPTURES.names)


def test_round_trip_and_pruning(spark, tmp_path):
    path = str(tmp_path / "captures")
    df = full(spark, [dict(id=i, t=i * 40_000, text=f"T {i}") for i in range(8)]).drop("textHash", "isSummarized")
    tables.append_captures(df.filter("id < 5"), path)
    tables.append_captures(df.filter("id >= 5"), path)
    back = tables.read_captures(spark, path)
    assert back.count() == 8 and back.schema.names == S.CAPTURES.names
    row = back.filter("id = 3").first()
    assert row.visibleWindows[0].appName == "W" and row.isSummarized is False and len(row.textHash) == 64
    part = tables.read_captures(spark, path, start=at(90_000), end=at(200_000))
    assert sorted(r.id for r in part.collect()) == [3, 4, 5]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "GreaterThanOrEqual(ts" in plan
    size = tables.storage_size(spark, path).first()
    assert size.bytes > 0 and size.files >= 4
    tables.write_export(back, str(tmp_path / "export"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "export")).collect()]
    assert len(lines) == 8 and set(lines[0]) == {"id", "time", "appName", "appBundleID", "windowTitle", "frameType", "keyframeId",
                                                 "changePercentage", "ocrText", "fullOcrText", "visibleWindows", "isSummarized"}
    values = [r.id for r in tables.export_json(back, ordered=True).collect()]
    assert values == list(range(7, -1, -1))


def test_json_source_is_lenient(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text("\n".join(json.dumps(r) for r in [
        dict(id=1, startTs="2024-01-01T00:00:00Z", endTs="2024-01-01T00:01:00Z", appNames='["a","b"]', summary="x", keyTopics=None, captureIds="[1,2]"),
        dict(id=2, startTs="2024-01-01T00:00:00Z", endTs="2024-01-01T00:01:00Z", appNames='{"a":1}', summary="y", keyTopics="[oops", captureIds="[3]")]))
    got = {r.id: (r.appNames, r.keyTopics, r.captureIds) for r in tables.read_summaries(spark, str(path), "json").collect()}
    assert got == {1: (["a", "b"], [], [1, 2]), 2: ([], [], [3])}
    with pytest.raises(ValueError):
        tables.read_summaries(spark, str(path), "xml")


def test_append_summaries_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "summaries")
    df = spark.createDataFrame([("k1", 1), ("k2", 2)], "chunkKey string, id long")
    tables.append_summaries(df, path, "chunkKey")
    tables.append_summaries(df.union(spark.createDataFrame([("k3", 3)], df.schema)), path, "chunkKey")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_closed_and_open_ends(spark):
    df = captures(spark, [dict(id=i, t=i * 10) for i in range(5)])
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(scan.captures_between(df, at(10), at(30))) == [3, 2, 1]
    assert ids(scan.captures_between(df, at(10), at(30), 2)) == [3, 2]
    assert ids(scan.captures_by_ids(df, [])) == [] and ids(scan.captures_by_ids(df, [4, 1, 77])) == [4, 1]
    assert ids(scan.unsummarized_older_than(df, at(320), 300)) == [0, 1, 2]
    assert sorted(ids(retention.prune_captures(df, at(7 * 86_400 + 20)))) == [2, 3, 4]
    assert retention.pruned_count(df, at(7 * 86_400 + 20)).first().deleted == 2
    assert stats.captures_per_hour(df, at(86_400 + 10)).first().captures == 3
    assert ids(scan.tail(df, 2)) == [3, 4] and scan.max_id(df.filter("id < 0")).first().last_id == 0
    assert stats.time_span(df.filter("id < 0")).first().oldest == "none"
    assert retention.mark_summarized(df, []) is df
    with_bundle = df.withColumn("appBundleID", F.lit(None).cast("string"))
    assert scan.capture_detail(with_bundle, 3).first().changePercent == "100.0%"
    only = stats.frame_type_stats(df).first()
    assert (only.keyframes, only.deltas, only.avg_keyframe_chars) == (5, 0, None)


def test_last_rows(spark):
    df = captures(spark, [dict(id=1, t=0, hash="a"), dict(id=2, t=5, hash="b"), dict(id=3, t=5, hash="c", type="delta")])
    assert scan.last_text_hash(df).first().textHash == "c"
    assert scan.last_keyframe(df).first().id == 2
    assert scan.last_text_hash(df.filter("id < 0")).first().textHash is None


def test_flag_is_derived(spark):
    df = captures(spark, [dict(id=i, t=i) for i in range(4)])
    s = spark.createDataFrame([([0, 2],), ([2],)], "captureIds array<long>")
    assert {r.id for r in retention.derive_summarized(df, s).filter("isSummarized").collect()} == {0, 2}
    assert {r.id for r in retention.unsummarized(df, s).collect()} == {1, 3}


def test_windows_column(spark):
    df = spark.createDataFrame([(1, '[{"appName":"a","windowTitle":null},{"appName":"b","windowTitle":"t"}]'), (2, None), (3, "{"), (4, "[]")], "id long, visibleWindows string")
    got = [(r.id, r.position, r.appName, r.windowTitle) for r in scan.decode_windows(df, json=True).collect()]
    assert got == [(1, 0, "a", None), (1, 1, "b", "t")]


@pytest.mark.parametrize("base", [1, 7, 60, 10_000])
def test_range_join(spark, base):
    s = [(i, at(i * 13 % 300), at(i * 13 % 300 + i % 40)) for i in range(60)]
    s += [(90, at(50), at(20)), (91, at(-5), at(1_000_000)), (92, None, at(1))]
    r = [(i, at(i * 29 % 320), at(i * 29 % 320 + i * 7 % 90)) for i in range(25)] + [(40, at(60), at(30)), (41, at(0), at(900_000_000))]
    got = joins.summaries_in_ranges(spark.createDataFrame(s, "id long, startTs timestamp, endTs timestamp"),
                                    spark.createDataFrame(r, "range_id long, start timestamp, end timestamp"), base)
    pairs = sorted((x.range_id, x.id) for x in got.collect())
    assert pairs == sorted((b[0], a[0]) for a in s for b in r if a[1] and a[2] >= b[1] and a[1] <= b[2])


def test_union_and_merge(spark):
    a = spark.createDataFrame([(3, 1), (1, 2)], "id long, position int")
    b = spark.createDataFrame([(1, 1), (2, 2)], "id long, position int")
    got = {r.id: (r.priority, r.position) for r in joins.ordered_union_distinct([a, b], position="position").collect()}
    assert got == {3: (0, 1), 1: (0, 2), 2: (1, 2)}
    df = captures(spark, [dict(id=i, t=i) for i in range(6)]).select("id", "ts", "device")
    assert [r.id for r in joins.merge_candidates(df.filter("id < 4"), df.filter("id > 2"), 3).collect()] == [5, 4, 3]
    assert joins.merge_candidates(df, df, 2, ["device"]).count() == 2
    assert T.LongType() == df.schema["id"].dataType


def test_range_rows_stay_few(spark):
    """A range of thirty years is laid over some dozens of buckets, however short the summaries are."""
    s = spark.createDataFrame([(i, at(i), at(i + 2 ** (i % 20))) for i in range(200)], "id long, startTs timestamp, endTs timestamp")
    r = spark.createDataFrame([(1, at(0), at(950_000_000))], "range_id long, start timestamp, end timestamp")
    got = joins.summaries_in_ranges(s, r)
    assert got.count() == 200
    exploded = joins._laid(r, "start", "end", "r", 60).select("__rlevel").first()[0]
    assert 20 < exploded < 30


def stamps(folder):
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in sorted(folder.rglob("*.parquet"))}


def test_retention_drops_folders(spark, tmp_path):
    """Old days go as folders, the day of the limit is rewritten, later days keep their files."""
    path = tmp_path / "captures"
    df = full(spark, [dict(id=i, t=i * 21_600) for i in range(40)])  # four a day
    tables.append_captures(df, str(path))
    before = stamps(path)
    now = at(7 * 86_400 + 4 * 86_400 + 22_000)  # the limit is on the fifth day, after its second row
    assert tables.drop_captures(spark, str(path), now, 7) == 18
    after = stamps(path)
    assert sorted(r.id for r in tables.read_captures(spark, str(path)).collect()) == list(range(18, 40))
    assert {f for f in after if not f.startswith("date=2024-01-05")} == {f for f in before if f >= "date=2024-01-06"}
    assert all(before[f] == t for f, t in after.items() if not f.startswith("date=2024-01-05"))
    assert tables.drop_captures(spark, str(path), now, 7) == 0 and stamps(path) == after
    assert tables.drop_captures(spark, str(path), at(400 * 86_400), 7) == 22 and not stamps(path)


def test_retention_of_summaries_and_usage(spark, tmp_path):
    s, u = str(tmp_path / "s"), str(tmp_path / "u")
    rows = spark.createDataFrame([(i, at(i * 40_000 - 60), at(i * 40_000), ["A"], "x", ["t"], [i]) for i in range(10)], S.SUMMARIES)
    tables.append_summaries(rows, s)
    usage = spark.createDataFrame([(i, at(i * 40_000), "c", "m", 1, 1) for i in range(10)], S.TOKEN_USAGE)
    tables.append_token_usage(usage, u)
    # A summary is as old as its end.
    now = at(86_400 + 120_000)
    assert tables.drop_summaries(spark, s, now, 1) == 3 == tables.drop_token_usage(spark, u, now, 1)
    assert sorted(r.id for r in tables.read_summaries(spark, s).collect()) == list(range(3, 10)) == sorted(r.id for r in tables.read_token_usage(spark, u).collect())
    assert tables.read_summaries(spark, s).schema.names == S.SUMMARIES.names


def test_storage_size_is_the_sum_of_the_files(spark, tmp_path):
    path = tmp_path / "captures"
    tables.append_captures(full(spark, [dict(id=i, t=i * 40_000) for i in range(9)]), str(path))
    files = list(path.rglob("*.parquet"))
    size = tables.storage_size(spark, str(path)).first()
    assert (size.bytes, size.files) == (sum(f.stat().st_size for f in files), len(files))


def test_a_large_day_has_several_writers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_PER_WRITER", 100, raising=False)
    rows = spark.range(1000).select("id", F.timestamp_seconds(F.when(F.col("id") < 900, 0).otherwise(F.col("id") * 86_400)).alias("ts"), F.lit("c").alias("caller"),
                                    F.lit("m").alias("model"), F.col("id").alias("inputTokens"), F.col("id").alias("outputTokens"))
    tables.append_token_usage(rows.unionByName(rows.limit(2).withColumn("ts", F.lit(None).cast("timestamp"))), str(tmp_path))
    assert 3 < len(list((tmp_path / "date=1970-01-01").glob("*.parquet"))) < 10
    assert len(list(tmp_path.rglob("*.parquet"))) < 115 and tables.read_token_usage(spark, str(tmp_path)).count() == 1002


def test_an_append_writes_a_file_a_day(spark, tmp_path):
    """Many small days: the files, whose names go to the driver, are as many as the days, not days times writers."""
    rows = spark.range(0, 4000, 1, 8).select("id", F.timestamp_seconds(F.col("id") % 100 * 86_400).alias("ts"), F.lit("c").alias("caller"), F.lit("m").alias("model"),
                                             F.col("id").alias("inputTokens"), F.col("id").alias("outputTokens"))
    tables.append_token_usage(rows, str(tmp_path / "usage"))
    assert len(list((tmp_path / "usage").rglob("*.parquet"))) == 100
    assert tables.read_token_usage(spark, str(tmp_path / "usage")).count() == 4000
    captures = S.from_columns(rows.withColumn("fullOcrText", F.lit("t")), {n: n for n in ("id", "ts", "fullOcrText")} | {
        n: F.lit(None) for n in S.CAPTURES.names if n not in ("id", "ts", "fullOcrText")}, S.CAPTURES)
    tables.append_captures(captures, str(tmp_path / "captures"))
    assert len(list((tmp_path / "captures").rglob("*.parquet"))) == 100
    assert tables.read_captures(spark, str(tmp_path / "captures")).count() == 4000


def test_crowded_ranges_are_dealt_to_many_tasks(spark, monkeypatch):
    """A few long ranges over all summaries, repeated and null rows: the pairs are those of a plain join, and no key of the join has them all."""
    monkeypatch.setattr(joins, "PART", 20, raising=False)
    s = spark.range(600).select((F.col("id") % 590).alias("id"), F.timestamp_seconds(F.col("id") * 60).alias("startTs"), F.timestamp_seconds(F.col("id") * 60 + 300).alias("endTs"))
    s = s.unionByName(s.limit(3)).unionByName(spark.createDataFrame([(None, None, None)], "id long, startTs timestamp, endTs timestamp"))
    r = spark.range(90).select(F.col("id").alias("range_id"), F.timestamp_seconds(F.col("id") * 30).alias("start"),
                               F.timestamp_seconds(F.col("id") * 30 + F.when(F.col("id") % 3 == 0, 100_000_000).when(F.col("id") % 5 == 1, -30).otherwise(90)).alias("end"))
    r = r.unionByName(r.filter("range_id = 9"))
    made = joins.summaries_in_ranges(s, r)
    got = sorted((x.range_id, x.id) for x in made.select("range_id", "id").collect())
    want = sorted((x.range_id, x.id) for x in s.join(r, (F.col("endTs") >= F.col("start")) & (F.col("startTs") <= F.col("end"))).select("range_id", "id").collect())
    assert got == want and set(made.columns) == {*s.columns, *r.columns}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "__lpart" in plan and "__rpart" in plan


def test_texts_of_a_key_are_cut_by_bytes(spark, monkeypatch):
    """Few rows of long texts are cut as well; ids may repeat or be null, and no row is lost or doubled."""

    rows = [(None if i % 11 == 0 else i // 2, at(i), "k%d" % (i % 2), " ".join(f"w{(i * j) % 17}" for j in range(40))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, k string, fullOcrText string")
    out = lambda d: sorted((str(r.id), r.ts, r.k, r.similarity, r.nearDuplicate) for r in d.collect())
    want = out(dedup.compare_with_previous(df, ["k"], threshold=0.5, cut=False))
    monkeypatch.setattr(dedup, "BYTES_PER_TASK", 2000, raising=False)
    made = dedup.compare_with_previous(df, ["k"], threshold=0.5)
    assert out(made) == want and len(want) == 300
    assert dedup._by_bytes(df, ["k"], "fullOcrText")["slices"] > 5


@pytest.mark.parametrize("threshold", [0.9, 0.5])
def test_all_rows_are_compared(spark, threshold):
    """Near copies are found wherever they stand, not only next to each other; against a loop over all pairs."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [rng.sample(words, 20) for _ in range(12)]
    texts = [None, "", " ", "A  b", "a B", "b a"]
    for _ in range(160):
        made = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            made[rng.randrange(len(made))] = rng.choice(words)
        texts.append(" ".join(made if rng.random() < .8 else rng.sample(words, rng.randint(1, 25))))
    rng.shuffle(texts)
    rows = [(None if i % 40 == 7 else i - i % 9 // 8, at(i % 50), "k", t) for i, t in enumerate(texts)]
    rows += rows[:5]
    made = dedup.near_duplicates(spark.createDataFrame(rows, "id long, ts timestamp, k string, fullOcrText string"), ["ts", "id"], threshold=threshold)

    def near(a, b):
        a, b = a.lower().split(), b.lower().split()
        return a == b or not a and not b or len({*a} & {*b}) / len({*a} | {*b}) >= threshold

    key = lambda r: (r[1], r[0] is not None, r[0] or 0)
    want = [(r[0], r[1], r[3], r[3] is not None and any(key(o) < key(r) and o[3] is not None and near(o[3], r[3]) for o in rows)) for r in rows]
    got = [(r.id, r.ts, r.fullOcrText, r.seenBefore) for r in made.collect()]
    plain = lambda found: sorted((str(i), ts.timestamp() if ts.tzinfo else ts.replace(tzinfo=dt.timezone.utc).timestamp(), str(t), s) for i, ts, t, s in found)
    assert plain(got) == plain(want)
    assert {s for *_, s in got} == {True, False}
