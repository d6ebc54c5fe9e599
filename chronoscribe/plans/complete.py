"""Calls of an injected language-model function over a table of prompts."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoscribe.session import durable, scratch, uri


class Completion(NamedTuple):
    text: str
    input_tokens: int | None = None
    output_tokens: int | None = None


class Complete(Protocol):
    def __call__(self, messages: list[dict], model: str, max_tokens: int, system: str | None,
                 temperature: float) -> Completion: ...


class CompletionError(Exception):
    """Failure with an HTTP-like status; 429 and 5xx are tried again."""

    def __init__(self, status: int, message: str = "", retry_after: float | None = None):
        super().__init__(message or f"status {status}")
        self.status, self.retry_after = status, retry_after

    def __reduce__(self):
        return CompletionError, (self.status, str(self), self.retry_after)


def call_with_retry(complete: Complete, prompt: str, model: str, max_tokens: int, system: str | None,
                    retries: int, sleep: Callable[[float], None] = time.sleep) -> Completion:
    attempt = 0
    while True:
        try:
            return complete([{"role": "user", "content": prompt}], model, max_tokens, system, 0.0)
        except CompletionError as error:
            again = error.status == 429 or error.status >= 500
            if not again or attempt >= retries - 1:
                raise
            sleep(error.retry_after if error.status == 429 and error.retry_after is not None else 2.0 ** attempt)
            attempt += 1


class Ledger:
    """Replies by the digest of what was asked, one small file each, in a folder that all tasks reach.

    A reply is written as soon as it is there, so a task that is run again, or twice at once, finds what was paid for already."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.system, self.path = fs.FileSystem.from_uri(uri)

    @staticmethod
    def digest(*asked) -> str:
        return hashlib.sha256(json.dumps(asked).encode()).hexdigest()

    def _file(self, digest: str) -> str:
        return f"{self.path}/{digest[:2]}/{digest}.json"

    def get(self, digest: str) -> Completion | None:
        try:
            with self.system.open_input_stream(self._file(digest)) as f:
                return Completion(*json.loads(f.read()))
        except FileNotFoundError:
            return None

    def put(self, digest: str, reply: Completion) -> None:
        self.system.create_dir(f"{self.path}/{digest[:2]}", recursive=True)
        part = f"{self._file(digest)}.{uuid.uuid4().hex}"
        with self.system.open_output_stream(part) as f:
            f.write(json.dumps(list(reply)).encode())
        self.system.move(part, self._file(digest))


def ai_map(df: DataFrame, prompt: str, complete: Complete, model: str = "default", max_tokens: int = 1024,
           system: str | None = None, retries: int = 3, threads: int = 8, keep: bool = True, ledger: str | None = None) -> DataFrame:
    """Add ``reply``, ``inputTokens``, ``outputTokens``, ``error`` for the prompt of every row.

    A call is a side effect, so its results are stored before use (``keep``): no later action calls
    again. A failed row carries its message in ``error``; the others go on. Replies are also written to a ledger one by one, so
    that a task that dies repeats none of its calls: a folder of this call, or ``ledger``, which later calls share.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType()),
                           T.StructField("inputTokens", T.LongType()), T.StructField("outputTokens", T.LongType()),
                           T.StructField("error", T.StringType())])
    folder = uri(ledger or scratch(df.sparkSession, "replies"))

    def one(book: Ledger, text: str | None):
        if text is None:
            return None, None, None, "no prompt"
        try:
            digest = book.digest(model, max_tokens, system, text)
            c = book.get(digest)
            if c is None:
                c = Completion(*call_with_retry(complete, text, model, max_tokens, system, retries))
                book.put(digest, c)
            return *c, None
        except Exception as error:  # noqa: BLE001 - reported per row
            return None, None, None, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = Ledger(folder)
        with ThreadPoolExecutor(max_workers=threads) as pool:
            for pdf in batches:
                got = list(pool.map(lambda text: one(book, text), pdf[prompt].tolist()))
                yield pdf.assign(
                    reply=[g[0] for g in got], inputTokens=pd.array([g[1] for g in got], dtype="Int64"),
                    outputTokens=pd.array([g[2] for g in got], dtype="Int64"), error=[g[3] for g in got])

    out = df.mapInPandas(run, schema)
    return durable(out) if keep else out


def usage_from_responses(replies: DataFrame, caller: str, model: str, ts: str = "ts", id: str = "id") -> DataFrame:
    """Token usage rows of the replies that report usage."""
    return replies.filter(F.col("inputTokens").isNotNull() & F.col("outputTokens").isNotNull()).select(
        F.col(id).cast("long").alias("id"), F.col(ts).alias("ts"), F.lit(caller).alias("caller"),
        F.lit(model).alias("model"), "inputTokens", "outputTokens")
