import pytest
from pyspark.sql import functions as F

from chronoscribe.functions import clock, numbers, replies, text
from chronoscribe.params import Params
from chronoscribe.plans.prompts import Templates
from helpers import at


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("v")).first().v


def test_normalize_and_hash(spark):
    assert one(spark, text.normalize_text("t"), t="  A b C\t\n d ") == "a b c d"
    assert one(spark, text.dedup_hash("t"), t="ABC") == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


@pytest.mark.parametrize("a,b,expected", [
    ("", " ", 1.0), ("", "x", 0.0), ("a b", "B a a", 1.0), ("a b c", "b c d", 0.5),
    ("a b c d e f g h i", "a b c d e f g h i j", 0.9)])
def test_jaccard(spark, a, b, expected):
    assert one(spark, text.jaccard_similarity("a", "b"), a=a, b=b) == expected
    assert one(spark, text.is_near_duplicate("a", "b"), a=a, b=b) == (expected >= 0.9)


def test_truncate_preview_template(spark):
    assert one(spark, text.truncate_text("t", 3), t="abc") == "abc"
    assert one(spark, text.truncate_text("t", 3), t="abcd") == "abc..."
    assert one(spark, text.preview("t", 3), t="a\nbcd") == "a b"
    tpl = text.render_template("{a}{b} {c} {a}", {"a": F.lit("{b}"), "b": F.lit("2")})
    assert one(spark, tpl) == "{b}2 {c} {b}"
    assert Templates().override(summary_user="", relevance_user="x").relevance_user == "x"
    assert Templates().override(summary_user="").summary_user == Templates().summary_user


@pytest.mark.parametrize("n,expected", [(0, "0"), (999, "999"), (1000, "1.0k"), (1550, "1.6k"), (1250, "1.2k"), (999_999, "1000.0k"), (1_075_000, "1.07M"), (12_345_678, "12.35M")])
def test_format_tokens(spark, n, expected):
    c = f"{n}" if n < 1000 else (f"{n / 1e3:.1f}k" if n < 1_000_000 else f"{n / 1e6:.2f}M")
    assert c == expected
    assert one(spark, numbers.format_tokens("n"), n=n) == expected


def test_fixed_equals_c_rounding(spark):
    values = [i / 40 for i in range(400)] + [0.05 * i for i in range(300)] + [-1.25, 1e9 + 0.35]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", numbers.fixed("v", 1).alias("a"), numbers.fixed("v", 2).alias("b"), numbers.fixed("v", 0).alias("c")).collect():
        assert (r.a, r.b, r.c) == (f"{r.v:.1f}", f"{r.v:.2f}", f"{r.v:.0f}"), r.v


def test_bytes(spark):
    assert [one(spark, numbers.format_bytes("n"), n=n) for n in (5, 12_000, 3_400_000, 1_250_000_000)] == [
        "5 bytes", "12 KB", "3.4 MB", "1.25 GB"]


def test_clock(spark):
    assert one(spark, clock.duration_text("s"), s=59.9) == "59s"
    assert one(spark, clock.duration_text("s"), s=185.7) == "3m 5s"
    assert one(spark, clock.range_label("m"), m=59) == "Last 59 min"
    assert one(spark, clock.range_label("m"), m=120) == "Last 2h 0m"
    assert one(spark, clock.clock_text(F.lit(at(3661)), "Europe/Berlin")) == "02:01:01"
    for raw, seconds in [("2024-01-01T00:00:01Z", 1), ("2024-01-01T00:00:01.250Z", 1.25), ("2024-01-01T01:00:01+01:00", 1)]:
        assert one(spark, clock.epoch_seconds(clock.iso_parse("t")), t=raw) == at(seconds).timestamp()
    assert one(spark, clock.iso_parse("t"), t="2024-01-01 00:00") is None
    ago = {0: "0 sec ago", 119: "1 min ago", 7200: "2 hr ago", -5: "in 5 sec", 86400 * 9: "1 wk ago"}
    for s, label in ago.items():
        assert one(spark, clock.relative_time(F.lit(at(0)), at(s))) == label


@pytest.mark.parametrize("raw,expected", [
    ("plain", "plain"), (" ```json\n{}\n``` ", "{}"), ("```\nx```", "x"), ("```x```", "```x"), ("a```", "a"), ("```", ""),
    ("x\n```y\n```", "x\n```y")])
def test_fences(spark, raw, expected):
    assert one(spark, text.strip_code_fences("t"), t=raw) == expected


@pytest.mark.parametrize("raw,summary,topics", [
    ('{"summary": "s", "key_topics": ["a", "b"]}', "s", ["a", "b"]),
    ('```json\n{"summary": "s", "key_topics": []}\n```', "s", []),
    ('{"summary": "s", "key_topics": ["a", 1]}', "s", []),
    ('{"summary": "s", "key_topics": ["a", null]}', "s", []),
    ('{"summary": 5, "key_topics": ["a"]}', '{"summary": 5, "key_topics": ["a"]}', ["a"]),
    ('{"key_topics": "a"}', '{"key_topics": "a"}', []),
    ("not json", "not json", []), ("[1]", "[1]", [])])
def test_parse_summary(spark, raw, summary, topics):
    got = one(spark, replies.parse_summary("t"), t=raw)
    assert (got.summary, got.keyTopics) == (summary, topics)


@pytest.mark.parametrize("raw,ids", [
    ('[{"id": 3}, {"id": 1, "reason": "x"}, {"id": 3}]', [3, 1, 3]), ('[{"id": 2.9}, {"id": 9}, {"id": "1"}, {}]', [2]),
    ('[{"id": 1}, 2]', []), ('[{"id": 1}, null]', []), ('{"id": 1}', []), ("[]", []), ("nope", []), ("```\n[{\"id\": 1}]\n```", [1])])
def test_parse_relevant(spark, raw, ids):
    assert one(spark, replies.parse_relevant_ids("t", F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), F.lit(3).cast("long"))), t=raw) == ids


def test_parse_citations(spark):
    raw = '''[{"timestamp": "t", "app_name": "a", "window_title": "w", "relevant_text": "r", "relevance_explanation": "e", "source": "summary"},
      {"relevant_text": "r2", "relevance_explanation": "e2", "app_name": 4}, {"relevant_text": "r3"}]'''
    got = one(spark, replies.parse_citations("t", F.lit("now")), t=raw)
    assert [tuple(c) for c in got] == [("t", "a", "w", "r", "e", "summary"), ("now", "Unknown", None, "r2", "e2", "capture")]
    assert one(spark, replies.parse_citations("t", F.lit("now")), t="[1]") == []


def test_params_ranges():
    Params(chunk_seconds=60, minimum_age=600)
    for bad in (dict(chunk_seconds=59), dict(retention_days=91), dict(keyframe_threshold=0.1), dict(max_keyframe_interval=301)):
        with pytest.raises(ValueError):
            Params(**bad)


def test_words_that_no_rule_changes_are_not_stemmed_one_by_one(monkeypatch):
    import random

    import pyarrow as pa
    from chronoscribe.functions import stems

    rnd = random.Random(3)
    ends = ["", "", "s", "ss", "sses", "ies", "eed", "ed", "ing", "y", "e", "ll", *[a for a, _ in stems.STEP_2 + stems.STEP_3], *stems.STEP_4]
    words = ["".join(rnd.choice("aeiouybcdlstz0é") for _ in range(rnd.randint(0, 6))) + rnd.choice(ends) + rnd.choice(ends) for _ in range(20000)]
    words += ["mond", "strab", "zu", "", "as", "a" * 63 + "s", "a" * 64 + "s", "ﬁed", "日", "és"]
    want = [stems.stem(w) for w in words]
    asked, one = [], stems.stem
    monkeypatch.setattr(stems, "stem", lambda w: asked.append(w) or one(w))
    assert stems.stem_words(pa.array([*words, None], pa.string())).to_pylist() == [*want, None]
    assert stems.stem_words(pa.array([], pa.string())).to_pylist() == [] and stems.stem_words(pa.array([None], pa.string())).to_pylist() == [None]
    assert not {"mond", "strab", "zu"} & set(asked) and len(asked) < len(words)
