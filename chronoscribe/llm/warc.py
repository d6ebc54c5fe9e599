"""WARC files: a request, a response or revisit, and a metadata record for each page; read back and assembled.

``write`` finds, for payloads that several pages share, the page with the largest id: that one is the
response, the others are revisits that refer to it. Records are gzip members. ``read`` returns one row for
each record; ``assemble`` joins the records of a capture through their concurrent-to identifiers and emits
one nested row.

Defined cases: a null html is an empty payload; a null url is written as ``about:blank``; rows that repeat
the largest page id of a payload are all responses, each a capture of its own; a null page id counts as
less than every other and is read back as null; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoscribe.llm import common, shards

#: A fixed time: pages have none of their own.
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAIN = ("response", "revisit")
RECORD = ("record_id string, record_type string, concurrent_to string, refers_to_target string, target string, "
          "record_date string, payload_digest string, payload_bytes bigint, http string, payload binary, fields string")


def _id(*parts) -> str:
    h = hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()[:32]
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _address(url: str | None) -> str:
    return " ".join((url or "").split()) or "about:blank"


def _member(kind: str, record: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def _capture(main: str, page, url, html: bytes, digest: str, first, first_url) -> bytes:
    """The three records of one page."""
    address = _address(url)
    head = [("WARC-Target-URI", address), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"),
            ("Content-Type", "application/http;msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    if first is None:
        answer = _member("response", main, head, http + html)
    else:
        answer = _member("revisit", main, [*head, ("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _address(first_url)),
                                           ("WARC-Refers-To-Date", DATE)], http)
    beside = [("WARC-Target-URI", address), ("WARC-Concurrent-To", main)]
    request = _member("request", _id("request", main), [*beside, ("Content-Type", "application/http;msgtype=request")],
                      f"GET {address} HTTP/1.1\r\nUser-Agent: archive\r\n\r\n".encode())
    fields = ("" if page is None else f"page-id: {page}\r\n") + ("" if first is None else f"first-page-id: {first}\r\n")
    metadata = _member("metadata", _id("metadata", main), [*beside, ("Content-Type", "application/warc-fields")], fields.encode())
    return request + answer + metadata


def write(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write the archives; the manifest: (part, folder, name, n_captures). Runs a job.

    Payloads of fewer than ``least`` bytes are always responses."""
    folder = shards.new_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col(page).cast("long").alias("page"), F.col(url).cast("string").alias("url"),
                        common.text_of(pages, html).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    shared = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(
        F.max(F.struct("page", "url")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = rows.join(shared.select("digest", "first"), "digest", "left").select(
        "page", "url", "html", "digest",
        F.when(~F.col("page").eqNullSafe(F.col("first.page")), F.col("first")).alias("first"))

    def run(batches):
        part, name = shards.own_name()
        system, path, n, out = None, "", 0, None
        for piece in common.pieces(batches, "html"):
            if out is None:
                system, path = shards.for_writing(folder)
                out = system.open_output_stream(f"{path}/{name}.warc.gz", compression=None)
            for r in piece.to_pylist():
                first = r["first"] or {}
                out.write(_capture(_id(folder, name, n), r["page"], r["url"], r["html"], r["digest"],
                                   first.get("page"), first.get("url")))
                n += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "folder": [folder], "name": [name],
                                          "n_captures": pa.array([n], pa.int64())})

    return common.cut(joined.mapInArrow(run, "part bigint, folder string, name string, n_captures bigint"))


def _records(stream, types: set[str]):
    """The records of a WARC stream that are of some types, as tuples in the order of ``RECORD``."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            head[key.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        kind = head["warc-type"]
        if kind not in types:
            continue
        digest, size, http, payload, fields = head.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None, None, None
        if kind in MAIN:
            top, _, rest = block.partition(b"\r\n\r\n")
            http = top.decode()
            size = next(int(x.partition(":")[2]) for x in http.split("\r\n") if x.lower().startswith("content-length:"))
            if kind == "response":
                payload = rest
                if len(rest) != size or base64.b32encode(hashlib.sha1(rest).digest()).decode() != digest:
                    raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
        else:
            fields = block.decode()
        yield (head["warc-record-id"], kind, head.get("warc-concurrent-to"), head.get("warc-refers-to-target-uri"),
               head.get("warc-target-uri"), head["warc-date"], digest, size, http, payload, fields)


def read(manifest: DataFrame, types: tuple[str, ...] = ("request", *MAIN, "metadata")) -> DataFrame:
    """One row for each record of the given types. Payloads are held against their digests."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = manifest.sparkSession.createDataFrame([], RECORD).schema
    arrow = to_arrow_schema(kind)
    wanted = set(types)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches):
        for batch in batches:
            for m in batch.to_pylist():
                if not m["n_captures"]:
                    continue
                system, path = shards.opened(m["folder"])
                with system.open_input_stream(f"{path}/{m['name']}.warc.gz", compression=None) as f, gzip.GzipFile(fileobj=f) as stream:
                    rows, held = [], 0
                    for r in _records(stream, wanted):
                        rows.append(r)
                        held += len(r[9] or b"") + 500
                        if held > common.PIECE:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts, "part").mapInArrow(run, kind)


def assemble(manifest: DataFrame) -> DataFrame:
    """One nested row for each capture: its response or revisit, with the request and the metadata that name
    it as concurrent. A capture without one of them has a null there."""
    main = read(manifest, MAIN).drop("concurrent_to", "fields")
    request = read(manifest, ("request",)).select(
        F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "target", F.col("fields").alias("head")).alias("request"))
    metadata = read(manifest, ("metadata",)).select(
        F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), F.col("fields").alias("fields")).alias("metadata"))
    number = lambda name: F.regexp_extract("metadata.fields", rf"(?:^|\n){name}: (-?\d+)", 1).try_cast("bigint")
    # Spark cannot know how much a reader of files returns; without the hint it would take it for small.
    return main.join(request.hint("merge"), "record_id", "left").join(metadata.hint("merge"), "record_id", "left").select(
        number("page-id").alias("page_id"), "target", "record_date",
        F.struct("record_id", "record_type", "payload_digest", "payload_bytes", "http", "payload", "refers_to_target",
                 number("first-page-id").alias("first_page_id")).alias("response"), "request", "metadata")
