"""Rows for the tests of the library."""
import datetime as dt

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds: float) -> dt.datetime:
    return BASE + dt.timedelta(seconds=seconds)


CAPTURE_SCHEMA = ("id long, ts timestamp, device string, appName string, windowTitle string, ocrText string, "
                  "fullOcrText string, textHash string, isSummarized boolean, frameType string, keyframeId long, "
                  "changePercentage double")


def captures(spark, rows):
    """Rows are dicts with at least id and t (seconds)."""
    out = []
    for r in rows:
        text = r.get("text", f"text {r['id']}")
        out.append((r["id"], at(r["t"]), r.get("device", "d"), r.get("app", "A"), r.get("title"), text,
                    r.get("full", text), r.get("hash", "h"), r.get("done", False), r.get("type", "keyframe"),
                    r.get("parent"), r.get("change", 1.0)))
    return spark.createDataFrame(out, CAPTURE_SCHEMA)
