"""Archives written and read back, against a loop over the pages."""
import base64
import hashlib

from pyspark.sql import functions as F

from chronoscribe.llm import warc

PAGES = [(1, "http://a", "<p>x</p>"), (5, "http://b", "<p>x</p>"), (3, None, "<p>x</p>"), (2, "http://c d", None), (4, "http://e", ""),
         (6, "http://f", "é\r\n\r\nWARC/1.1\r\n" * 9), (7, "http://g", "y" * 300_000), (8, "http://h", "z"), (8, "http://h", "z"),
         (9, "http://i", "w"), (9, "http://i", "v"), (None, "http://j", "z"), (None, None, "only")]


def expected(pages):
    out = []
    for page, _, html in pages:
        body = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == body and p is not None]
        first = max(same, default=None)
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    *(("response", None) if page == first else ("revisit", first))))
    return sorted(map(repr, out))


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "q") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    rows = warc.assemble(warc.write(df)).collect()
    got = [(r.page_id, r.response.payload_bytes, r.response.payload_digest, r.response.record_type, r.response.first_page_id) for r in rows]
    assert sorted(map(repr, got)) == expected(PAGES)
    for r in rows:
        assert r.request.head.startswith(f"GET {r.target} ") and r.metadata is not None
        assert (r.response.payload is None) == (r.response.record_type == "revisit")
    assert len({r.response.record_id for r in rows}) == len(PAGES)


def test_least_size_and_empty(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warc.assemble(warc.write(df, least=2)).filter(F.col("response.record_type") == "revisit").collect()
    assert sorted(r.page_id for r in rows) == [1, 3]
    assert warc.assemble(warc.write(df.limit(0))).count() == 0


def test_records_of_each_kind(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    kinds = {r.record_type: r["count"] for r in warc.read(warc.write(df)).groupBy("record_type").count().collect()}
    assert kinds["request"] == kinds["metadata"] == kinds["response"] + kinds["revisit"] == len(PAGES)
