"""Full-text search with phrase matching and BM25.

A query is a list of words; every word is a phrase of one or more tokens that
must be adjacent in one field, and all phrases must occur (in any fields). Two
ways lead to the same ranking:

* ``rank_documents`` scans the texts once, stores the rows with a hit and takes the statistics from the same
  pass; it suits a table without an index;
* ``TextIndex`` reads only the postings of the query's terms. Every search takes one as ``index``.

Searches without an index, ``search_many`` and ``TextIndex.build(keep=True)`` run jobs when they are called and
leave tables below ``spark.checkpoint.dir``; ``session.remove_stored`` deletes them.

Statistics (row count, mean length, rows per phrase) are always those of the
whole table; filters on rows come after scoring and before the limit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from chronoscribe.functions.clock import local_time, seconds_before
from chronoscribe.functions.stems import stem as stem_one
from chronoscribe.functions.stems import stem_tokens, stem_words
from chronoscribe.functions.text import TOKEN_PATTERN, like_contains, raw_tokens
from chronoscribe.operators.postings import counted, listed, pack, pack_lists, positions, tops, tops_listed, unlisted
from chronoscribe.session import stored

# BM25 parameters and the floor of the inverse document frequency.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6

CAPTURE_FIELDS = ["fullOcrText", "windowTitle", "appName"]

# Query-side tables (terms, phrases of queries) are broadcast up to this number of counted rows; beyond it they
# are joined like any other table.
BROADCAST_ROWS = 200_000


def summary_fields() -> list[Column]:
    return [F.col("summary"), F.to_json("keyTopics"), F.to_json("appNames")]


# -- queries -----------------------------------------------------------------


def sanitize_query(text: str) -> list[str]:
    """Words of the query without double quotes."""
    return [w.replace('"', "") for w in text.split()]


def query_tokens(text: str, stem: bool = True) -> list[str]:
    tokens = regex.findall(TOKEN_PATTERN, text.lower())
    return [stem_one(t) for t in tokens] if stem else tokens


def parse_query(text: str, stem: bool = True) -> list[list[str]]:
    """Token list of every word; an empty result matches nothing."""
    phrases = [query_tokens(w, stem) for w in sanitize_query(text)]
    return phrases if all(phrases) else []


def parse_phrase(text: str, stem: bool = True) -> list[list[str]]:
    """The whole text as one phrase."""
    tokens = query_tokens(text.replace('"', ""), stem)
    return [tokens] if tokens else []


def tokenize(col: str | Column, stem: bool = True) -> Column:
    """Token array in text order. ``stem=False`` stays in the JVM."""
    tokens = raw_tokens(col)
    return stem_tokens(tokens) if stem else tokens


def _joined_tokens(fields: list[str | Column], stem: bool) -> Column:
    """Tokens of all fields in one array, with a null between fields to stop phrases."""
    parts: list[Column] = []
    for f in fields:
        if parts:
            parts.append(F.array(F.lit(None).cast("string")))
        parts.append(raw_tokens(f))
    flat = parts[0] if len(parts) == 1 else F.concat(*parts)
    return stem_tokens(flat) if stem else flat


# -- scan search -------------------------------------------------------------


def _occurrences(tokens: Column, phrase: list[str]) -> Column:
    def starts(x: Column, i: Column) -> Column:
        ok = x == F.lit(phrase[0])
        for offset, term in enumerate(phrase[1:], 1):
            ok = ok & F.coalesce(F.get(tokens, i + F.lit(offset)) == F.lit(term), F.lit(False))
        return ok
    return F.size(F.filter(tokens, starts))


def _idf(rows: Column, hits: Column) -> Column:
    raw = F.log((rows - hits + F.lit(0.5)) / (hits + F.lit(0.5)))
    return F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)


def _weight(tf: Column, length: Column, mean: Column) -> Column:
    f = tf.cast("double")
    return f * F.lit(K1 + 1) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / mean))


def rank_documents(docs: DataFrame, fields: list[str | Column], phrases: list[list[str]], stem: bool = True,
                   id: str = "id", keep: list[str] = ()) -> DataFrame:
    """``id``, ``rank`` (negative BM25, best first) of every matching row, plus ``keep`` columns."""
    if not phrases:
        return docs.select(id, *keep, F.lit(0.0).alias("rank")).filter(F.lit(False))
    names = [f"__tf{i}" for i in range(len(phrases))]
    tokens = F.col("__tokens")
    counted = docs.select(id, *keep, _joined_tokens(fields, stem).alias("__tokens")).select(
        id, *keep,
        # A one-row generator keeps the filter below from re-evaluating the tokens.
        F.inline(F.array(F.struct(
            (F.size("__tokens") - F.lit(len(fields) - 1)).alias("__len"),
            *[_occurrences(tokens, p).alias(n) for p, n in zip(phrases, names)]))))
    # One pass over the texts: statistics of all rows are observed while the rows with every phrase are stored.
    seen = Observation()
    counted = counted.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.sum(F.col("__len").cast("long")).alias("tokens"),
        *[F.count_if(F.col(n) > 0).alias(f"df{i}") for i, n in enumerate(names)])
    matched = counted
    for n in names:
        matched = matched.filter(F.col(n) > 0)
    matched = stored(matched)
    stats = seen.get
    mean = F.lit(float((stats["tokens"] or 0) / max(1, stats["rows"])))
    score = F.lit(0.0)
    for i, n in enumerate(names):
        score = score + _idf(F.lit(stats["rows"]), F.lit(stats[f"df{i}"])) * _weight(F.col(n), F.col("__len"), mean)
    return matched.select(id, *keep, (-score).alias("rank"))


def best(ranked: DataFrame, limit: int, id: str = "id") -> DataFrame:
    return ranked.orderBy("rank", id).limit(limit)


def fetch(table: DataFrame, top: DataFrame, limit: int, id: str = "id") -> DataFrame:
    """Wide rows of the ranked ids, best first. The ids are broadcast: they are a top-``limit``."""
    small = F.broadcast(top.select(F.col(id).alias("__id"), "rank").limit(limit))
    return table.join(small, F.col(id) == F.col("__id")).drop("__id").orderBy("rank", id)


def _ranked(table: DataFrame, fields: list[str | Column], parse, text: str, stem: bool, index: "TextIndex | None",
            keep: list[str] = ()) -> DataFrame:
    """``id``, ``rank`` and ``keep`` through the index, whose own stemming counts, or by a scan of the texts."""
    if index is None:
        return rank_documents(table, fields, parse(text, stem), stem, keep=keep)
    ranked = index.rank(parse(text, index.stem))
    return ranked.join(table.select("id", *keep), "id") if keep else ranked


def _top(table: DataFrame, fields: list[str | Column], parse, text: str, limit: int, stem: bool, index: "TextIndex | None") -> DataFrame:
    """The ``limit`` best of ``_ranked``."""
    if index is None:
        return best(_ranked(table, fields, parse, text, stem, None), limit)
    return index.top(parse(text, index.stem), limit)


def search_captures(captures: DataFrame, text: str, limit: int = 50, stem: bool = True,
                    index: "TextIndex | None" = None) -> DataFrame:
    """Best ``limit`` captures of all times, with ``rank``."""
    return fetch(captures, _top(captures, CAPTURE_FIELDS, parse_query, text, limit, stem, index), limit)


def search_phrase(captures: DataFrame, text: str, limit: int = 20, chars: int = 120, stem: bool = True,
                  tz: str = "UTC", index: "TextIndex | None" = None) -> DataFrame:
    """The whole argument as one phrase, with a text preview."""
    return fetch(captures, _top(captures, CAPTURE_FIELDS, parse_phrase, text, limit, stem, index), limit).select(
        "id", local_time("ts", tz).alias("time"), F.col("frameType").alias("type"), F.col("appName").alias("app"),
        F.col("windowTitle").alias("window"), F.substring("fullOcrText", 1, chars).alias("text_preview"), "rank")


def search_phrase_summaries(summaries: DataFrame, text: str, limit: int = 20, chars: int = 150, stem: bool = True,
                            tz: str = "UTC", index: "TextIndex | None" = None) -> DataFrame:
    return fetch(summaries, _top(summaries, summary_fields(), parse_phrase, text, limit, stem, index), limit).select(
        "id", local_time("startTs", tz).alias("start"), F.to_json("appNames").alias("apps"),
        F.substring("summary", 1, chars).alias("summary_preview"), "rank")


def search_summaries(summaries: DataFrame, text: str, limit: int = 20, now=None, minutes: float | None = None,
                     app: str | None = None, stem: bool = True, index: "TextIndex | None" = None) -> DataFrame:
    """Best ``limit`` summaries; time and app filters act before the limit, not on the statistics."""
    keep = ["endTs"] * (minutes is not None) + ["appNames"] * bool(app)
    ranked = _ranked(summaries, summary_fields(), parse_query, text, stem, index, keep)
    if minutes is not None:
        ranked = ranked.filter(F.col("endTs") >= seconds_before(now, minutes * 60))
    if app:
        ranked = ranked.filter(like_contains(F.to_json("appNames"), app))
    return fetch(summaries, best(ranked, limit), limit)


# -- postings ----------------------------------------------------------------


def token_rows(docs: DataFrame, fields: dict[str, str | Column], stem: bool = True, id: str = "id") -> DataFrame:
    """``(id, len, f)``: number of tokens of a row and the token arrays of its fields as
    ``array<struct<field, tokens>>``."""
    tokens = [raw_tokens(col) for col in fields.values()]
    if stem:
        tokens = [stem_tokens(t) for t in tokens]
    rows = docs.select(F.col(id).alias("id"), F.array(*[
        F.struct(F.lit(name).alias("field"), t.alias("tokens")) for name, t in zip(fields, tokens)]).alias("f"))
    return rows.select("id", F.aggregate("f", F.lit(0), lambda n, x: n + F.size(x["tokens"])).alias("len"), "f")


def _postings(rows: DataFrame) -> DataFrame:
    # ``inline`` makes the members columns of their own: a generator that still carried the struct
    # would copy the whole token array beside every token.
    return rows.select("id", F.inline("f")).select("id", "field", F.posexplode("tokens").alias("pos", "term"))


def build_postings(docs: DataFrame, fields: dict[str, str | Column], stem: bool = True, id: str = "id") -> DataFrame:
    """``(id, field, pos, term)``, one row per token; a map-only job."""
    return _postings(token_rows(docs, fields, stem, id))


def document_lengths(docs: DataFrame, fields: dict[str, str | Column], id: str = "id") -> DataFrame:
    """``(id, len)``: tokens over all fields. Stemming does not change the number of tokens."""
    return token_rows(docs, fields, False, id).select("id", "len")


_SEGMENT = 1 << 40
#: Terms of fewer rows have no stored blocks; their postings are read whole.
FREQUENT = 128
#: Tokens whose postings a writer of an index sorts, about; the number of writers grows with the tokens. A writer that packs texts itself, for
#: all buckets, takes four times as many, or fewer where that leaves cores idle, but not below the least.
TOKENS_PER_WRITER, LEAST_TOKENS = 1_500_000, 500_000
#: Blocks that are read first, to learn which rank the last one of the best has.
FIRST = 32


def _level() -> Column:
    """Blocks hold rows of like length: a row's weight depends on its length, so blocks differ in what they can reach."""
    return F.floor(F.log2(F.col("len") + F.lit(1)) * 4).cast("int")


def _blocks(lists: DataFrame, buckets: int) -> DataFrame:
    """``tops`` of the frequent terms of lists, by bucket. The bucket follows from the term, so it does not travel."""
    frequent = stored(lists.groupBy("term").agg(F.sum("n").alias("df")).filter(F.col("df") >= FREQUENT).select("term"))
    few = F.broadcast(frequent) if frequent.count() <= BROADCAST_ROWS else frequent
    return tops_listed(lists.select("term", "n", "block", "tf", "len").join(few, "term", "left_semi")).withColumn("bucket", TextIndex._bucket(buckets))


@dataclass(frozen=True)
class TextIndex:
    """Packed postings of one table (see ``postings``), in segments of blocks.

    A deleted row stays where it is; its id and block are in ``gone`` and are left out of whatever is read. So a delete
    costs a look at the lengths, an update a delete and a segment of its own, and neither touches the postings. ``totals`` has the
    rows and tokens of each segment, deleted ones included. ``blocks`` tell what the rows of a block can weigh at most (``top``)."""

    postings: DataFrame           # id, len, term, tf, at, block (and bucket)
    lengths: DataFrame            # id, len, block
    totals: DataFrame             # rows, tokens
    stem: bool = True
    buckets: int | None = None
    blocks: DataFrame | None = None
    gone: DataFrame | None = None
    segments: int = 1
    texts: tuple | None = None    # what the postings are packed from, if they are not stored

    # -- making, saving ---------------------------------------------------

    @classmethod
    def build(cls, docs: DataFrame, fields: dict[str, str | Column], stem: bool = True, id: str = "id",
              keep: bool = True) -> "TextIndex":
        """With ``keep`` the packed postings are stored, so each text is tokenised once however often
        the index is read; without it everything stays lazy (as for ``save``)."""
        columns, block = list(fields.values()), F.lit(0).cast("long")
        if keep:
            return cls._of(stored(pack(docs, id, columns, stem_words if stem else None)).withColumn("block", block), stem)
        rows = pack(docs, id, columns, stem_words if stem else None).filter("term IS NOT NULL")
        # Stemming does not change the number of tokens; cutting texts again takes less than storing all postings.
        lengths = pack(docs, id, columns, places=False).select("id", "len").withColumn("block", block)
        return replace(cls._with(rows.withColumn("block", block), lengths, stem), texts=(docs, id, columns, stem_words if stem else None))

    @classmethod
    def _of(cls, rows: DataFrame, stem: bool) -> "TextIndex":
        return cls._with(rows.filter("term IS NOT NULL"), rows.filter("term IS NULL").select("id", "len", "block"), stem)

    @classmethod
    def _with(cls, postings: DataFrame, lengths: DataFrame, stem: bool) -> "TextIndex":
        totals = lengths.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("len").cast("long")), F.lit(0)).alias("tokens"))
        return cls(postings, lengths, totals, stem)

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")

    def save(self, path: str, buckets: int = 64, parts_per_bucket: int = 8, mode: str = "overwrite",
             rows_per_block: int = 1024) -> None:
        """Postings by term bucket, as lists (see ``postings``), runs of them sorted by term and block inside files, and the blocks of frequent terms. The postings of a
        frequent term are spread over ``parts_per_bucket`` writers by block, or more where there are many postings. ``mode="append"`` adds a segment; ids that are there
        already are refused, since their postings would count twice (see ``delete``)."""
        spark = self.lengths.sparkSession
        segment = 0
        if mode == "append":
            there = TextIndex.load(spark, path, self.stem, buckets)
            segment = there.segments
            if not self.lengths.join(there._alive(there.lengths).select("id"), "id", "left_semi").isEmpty():
                raise ValueError("ids of this batch are in the index; delete them first")
        # The lengths alone are stored.
        lengths = stored(self._alive(self.lengths).select("id", "len"))
        levels = lengths.groupBy(_level().alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("len").cast("long")).alias("tokens")).orderBy("level").collect()
        # Four levels an octave, so some hundred at most.
        blocks = [-(-r["n"] // rows_per_block) for r in levels]
        of_level = lambda numbers: F.element_at(F.create_map(*[F.lit(x) for r, n in zip(levels, numbers) for x in (r["level"], n)] or [F.lit(0), F.lit(1)]), _level())
        number = F.pmod(F.xxhash64("id"), of_level(blocks))
        block = F.lit(segment * _SEGMENT) + _level().cast("long") * (1 << 32) + number
        # A writer sorts a bounded number of postings; blocks stay whole.
        tokens, bucket = sum(r["tokens"] for r in levels), self._bucket(buckets)
        if self.texts is not None:
            # Texts are dealt and packed where they are written: they take far less to move than their postings.
            docs, id, columns, stem = self.texts
            idle = min(spark.sparkContext.defaultParallelism, -(-tokens // LEAST_TOKENS))
            writers = max(parts_per_bucket, idle, -(-tokens // (4 * TOKENS_PER_WRITER)))
            writer = F.pmod(of_level([sum(blocks[:i]) for i in range(len(blocks))]) + number, F.lit(writers)).cast("int")
            dealt = counted(docs, id, columns).withColumn("block", block).repartitionById(writers, writer).sortWithinPartitions("block", "id")
            lists = pack_lists(dealt, len(columns), stem)
        else:
            writers = max(parts_per_bucket, -(-tokens // (buckets * TOKENS_PER_WRITER)))
            dealt = self._alive(self.postings).withColumn("block", block).repartitionById(buckets * writers, bucket * writers + F.pmod(F.xxhash64("block"), F.lit(writers)).cast("int"))
            lists = listed(dealt.sortWithinPartitions("term", "block", "id"))
        made = TextIndex._with(lists, lengths.withColumn("block", block), self.stem)
        lists = lists.withColumn("segment", F.lit(segment)).withColumn("bucket", bucket)
        lists.sortWithinPartitions("bucket").write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
        made.lengths.write.mode(mode).parquet(f"{path}/lengths")
        written = TextIndex._lists(spark, path, lengths).filter(F.col("segment") == segment)
        _blocks(written, buckets).write.mode(mode).partitionBy("bucket").parquet(f"{path}/blocks")
        made.totals.withColumn("segment", F.lit(segment)).write.mode(mode).parquet(f"{path}/totals")
        made.lengths.filter(F.lit(False)).write.mode(mode).parquet(f"{path}/gone")

    @staticmethod
    def _lists(spark: SparkSession, path: str, lengths: DataFrame) -> DataFrame:
        kind = lengths.schema["id"].dataType.simpleString()
        return spark.read.schema(f"term string, n int, block binary, id array<{kind}>, len binary, tf binary, at binary, segment int, bucket int").parquet(f"{path}/postings")

    @classmethod
    def load(cls, spark: SparkSession, path: str, stem: bool = True, buckets: int = 64) -> "TextIndex":
        totals, gone = spark.read.parquet(f"{path}/totals"), spark.read.parquet(f"{path}/gone")
        segments = totals.agg(F.max("segment")).first()[0] + 1
        lengths = spark.read.parquet(f"{path}/lengths")
        # Tables by bucket have no file where they have no row.
        postings = unlisted(cls._lists(spark, path, lengths), {"id": lengths.schema["id"].dataType, "len": "int", "tf": "int", "at": "binary", "block": "long"})
        blocks = spark.read.schema("term string, n int, block binary, tf binary, rows binary, len binary, bucket int").parquet(f"{path}/blocks")
        blocks = unlisted(blocks, {"block": "long", "tf": "int", "rows": "long", "len": "int"})
        return cls(postings, lengths, totals.select("rows", "tokens"), stem, buckets, blocks, None if gone.isEmpty() else gone, segments)

    @classmethod
    def delete(cls, spark: SparkSession, path: str, ids: DataFrame) -> None:
        """Delete rows of a saved index: their ids and blocks are added to those that are gone."""
        index = cls.load(spark, path)
        stored(index._found(ids)).write.mode("append").parquet(f"{path}/gone")

    # -- maintenance ---------------------------------------------------------

    def _alive(self, rows: DataFrame) -> DataFrame:
        if self.gone is None:
            return rows
        return rows.join(self.gone.select("id", "block"), ["id", "block"], "left_anti")

    def _found(self, ids: DataFrame) -> DataFrame:
        return self._alive(self.lengths).join(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "id", "left_semi").select("id", "len", "block")

    def without(self, ids: DataFrame) -> "TextIndex":
        """Drop deleted rows. Only lengths are read."""
        found = stored(self._found(ids))
        return replace(self, gone=found if self.gone is None else self.gone.unionByName(found), texts=None)

    def plus(self, other: "TextIndex") -> "TextIndex":
        """Add the rows of another batch, which has none of this index's ids, as segments of their own."""
        if self.stem != other.stem:
            raise ValueError("one index stems, the other does not")
        after = lambda df: df.withColumn("block", F.col("block") + F.lit(self.segments * _SEGMENT))
        more = after(other.postings)
        mine = self.postings
        if self.buckets is not None:
            more = more if other.buckets == self.buckets else more.withColumn("bucket", self._bucket(self.buckets))
        elif "bucket" in more.columns:
            more = more.drop("bucket")
        blocks = None
        if self.blocks is not None:
            extra = after(other.blocks) if other.blocks is not None and other.buckets == self.buckets else tops(more.select("term", "block", "tf", "len")).withColumn("bucket", self._bucket(self.buckets))
            blocks = self.blocks.unionByName(extra)
        gone = [g for g in (self.gone, None if other.gone is None else after(other.gone)) if g is not None]
        return replace(self, postings=mine.unionByName(more.select(*mine.columns)), lengths=self.lengths.unionByName(after(other.lengths)),
                       totals=self.totals.unionByName(other.totals), blocks=blocks, segments=self.segments + other.segments,
                       gone=reduce(DataFrame.unionByName, gone) if gone else None, texts=None)

    def updated(self, other: "TextIndex") -> "TextIndex":
        """Rows of ``other`` in place of those with the same id: delete, then insert."""
        return self.without(other.lengths.select("id")).plus(other)

    # -- reading ------------------------------------------------------------

    def _in_buckets(self, rows: DataFrame, terms: DataFrame) -> DataFrame:
        """Rows of the buckets that hold the terms; the driver gets at most one number for each bucket."""
        if self.buckets is None:
            return rows
        wanted = terms.select(self._bucket(self.buckets).alias("bucket")).distinct().collect()
        return rows.filter(F.col("bucket").isin(sorted(r[0] for r in wanted)))

    def _of_terms(self, terms: list[str], rows: DataFrame | None = None) -> DataFrame:
        rows = self.postings if rows is None else rows
        listed = rows.sparkSession.createDataFrame([(t,) for t in terms], "term string")
        return self._in_buckets(rows, listed).filter(F.col("term").isin(terms))

    def of_buckets(self, terms: DataFrame) -> DataFrame:
        """Packed postings, without deleted rows, of the buckets that hold the terms."""
        return self._alive(self._in_buckets(self.postings, terms))

    def _corpus(self) -> Column:
        """``struct(rows, mean)`` of the whole table as a scalar subquery."""
        totals = self.totals
        if self.gone is not None:
            totals = totals.unionByName(self.gone.agg((-F.count(F.lit(1))).alias("rows"), (-F.coalesce(F.sum(F.col("len").cast("long")), F.lit(0))).alias("tokens")))
        return totals.agg(F.struct(F.sum("rows").alias("rows"), (F.sum("tokens") / F.sum("rows")).alias("mean"))).scalar()

    def occurrences(self, phrases: list[list[str]], within: DataFrame | None = None) -> DataFrame:
        """``(id, len, block, phrase, tf)`` of each phrase number in each row that contains it; of ``within``, if given."""
        one: dict[str, list[Column]] = {}
        more: dict[str, list[Column]] = {}
        for i, p in enumerate(phrases):
            if len(p) == 1:
                one.setdefault(p[0], []).append(F.lit(i))
            for o, t in enumerate(p) if len(p) > 1 else ():
                more.setdefault(t, []).append(F.struct(F.lit(i).alias("phrase"), F.lit(o).alias("o"), F.lit(len(p)).alias("n")))
        lookup = lambda d: F.element_at(F.create_map(*[c for t, v in d.items() for c in (F.lit(t), F.array(*v))]), F.col("term"))
        found = []
        rows = self._alive(self._of_terms(sorted({*one, *more}), within))
        if one:
            # Counts are read, positions are not.
            found.append(rows.filter(F.col("term").isin(sorted(one))).select("id", "len", "block", F.explode(lookup(one)).alias("phrase"), F.col("tf").cast("long")))
        if more:
            places = rows.filter(F.col("term").isin(sorted(more))).select("id", "len", "block", "term", F.explode(positions("at")).alias("pos"))
            starts = (places.select("id", "len", "block", "pos", F.inline(lookup(more))).groupBy("id", "len", "block", "phrase", "n", (F.col("pos") - F.col("o")).alias("s"))
                      .agg(F.count(F.lit(1)).alias("c")).filter("c = n"))
            found.append(starts.groupBy("id", "len", "block", "phrase").agg(F.count(F.lit(1)).alias("tf")))
        return reduce(DataFrame.unionByName, found)

    def _scored(self, tf: DataFrame, df: DataFrame, phrases: int) -> DataFrame:
        """``(id, rank)`` of the rows that have all phrases; ``df`` has one row a phrase."""
        weight = _idf(F.col("__c.rows"), F.col("df")) * _weight(F.col("tf"), F.col("len"), F.col("__c.mean"))
        weighted = tf.join(F.broadcast(df), "phrase").withColumn("__c", self._corpus()).select("id", weight.alias("w"))
        return (weighted.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
                .filter(F.col("n") == phrases).select("id", (-F.col("w")).alias("rank")))

    def rank(self, phrases: list[list[str]]) -> DataFrame:
        """``(id, rank)`` of the rows that contain every phrase."""
        if not phrases:
            return self.lengths.select("id", F.lit(0.0).alias("rank")).filter(F.lit(False))
        tf = self.occurrences(phrases)
        # One row per phrase of the query.
        return self._scored(tf, tf.groupBy("phrase").agg(F.count(F.lit(1)).alias("df")), len(phrases))

    def bounds(self, phrases: list[list[str]]) -> tuple[DataFrame, DataFrame]:
        """For single tokens: ``(phrase, df)``, and ``(block, rows, bound)``: the blocks that have all of them, and what a row of
        theirs weighs at most. Reads blocks of frequent terms and whole postings of rare ones."""
        terms = [p[0] for p in phrases]
        listed = sorted(set(terms))
        known = stored(self._of_terms(listed, self.blocks).select("term", "block", "tf", "rows", "len"))
        covered = known.select("term", F.floor(F.col("block") / _SEGMENT).alias("segment")).distinct()
        # A term may be frequent in some segments only.
        if covered.count() < len(listed) * self.segments:
            left = self._of_terms(listed).withColumn("segment", F.floor(F.col("block") / _SEGMENT)).join(F.broadcast(covered), ["term", "segment"], "left_anti")
            known = known.unionByName(tops(left.select("term", "block", "tf", "len")))
        df = known.groupBy("term").agg(F.sum("rows").alias("df"))
        if self.gone is not None:
            # Deleted rows are looked for in their own blocks only.
            hit = F.broadcast(self.gone.select("block").distinct()) if self.gone.count() <= BROADCAST_ROWS else self.gone.select("block").distinct()
            dead = (self._of_terms(listed).join(hit, "block", "left_semi").join(self.gone.select("id", "block"), ["id", "block"], "left_semi")
                    .groupBy("term").agg((-F.count(F.lit(1))).alias("df")))
            df = df.unionByName(dead).groupBy("term").agg(F.sum("df").alias("df"))
        phrase = F.explode(F.element_at(F.create_map(*[c for t in listed for c in (F.lit(t), F.array(*[F.lit(i) for i, x in enumerate(terms) if x == t]))]), F.col("term")))
        df = stored(df.filter("df > 0").select(phrase.alias("phrase"), "df"))
        per_phrase = known.select("block", "tf", "rows", "len", phrase.alias("phrase")).join(F.broadcast(df), "phrase").withColumn("__c", self._corpus())
        most = _idf(F.col("__c.rows"), F.col("df")) * _weight(F.col("tf"), F.col("len"), F.col("__c.mean"))
        blocks = (per_phrase.select("block", "phrase", "rows", most.alias("w"))
                  .groupBy("block", "phrase").agg(F.sum("rows").alias("rows"), F.max("w").alias("w"))
                  .groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("bound"), F.min("rows").alias("rows"))
                  .filter(F.col("n") == len(phrases)).select("block", "rows", "bound"))
        return df, stored(blocks)

    def top(self, phrases: list[list[str]], limit: int, seen: dict | None = None) -> DataFrame:
        """The ``limit`` best rows of ``rank``, best first. For single tokens of a saved index, blocks with the highest bounds are
        ranked first; then only those that can still reach the rank of the last of the best. ``seen`` gets the number of
        blocks with all tokens (``blocks``) and of those read (``read``)."""
        if self.blocks is None or not phrases or any(len(p) > 1 for p in phrases) or limit < 1:
            return best(self.rank(phrases), limit)
        df, blocks = self.bounds(phrases)
        head = [r[0] for r in blocks.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
        first = stored(best(self._scored(self.occurrences(phrases, self.postings.filter(F.col("block").isin(head))), df, len(phrases)), limit))
        last = first.agg(F.count(F.lit(1)), F.max("rank")).first()
        rest = blocks.filter(~F.col("block").isin(head))
        if last[0] >= limit:
            # A little below, since sums of doubles may round otherwise.
            rest = rest.filter(F.col("bound") >= -last[1] - 1e-9)
        n = rest.count()
        if seen is not None:
            seen.update(blocks=blocks.count(), read=len(head) + n)
        if not n:
            return best(first, limit)
        chosen = F.broadcast(rest.select("block")) if n <= BROADCAST_ROWS else rest.select("block")
        more = self._scored(self.occurrences(phrases, self.postings.join(chosen, "block", "left_semi")), df, len(phrases))
        return best(first.unionByName(best(more, limit)), limit)

    def search(self, text: str, limit: int = 50) -> DataFrame:
        return self.top(parse_query(text, self.stem), limit)


# -- many queries ------------------------------------------------------------


def query_phrases(queries: DataFrame, stem: bool = True, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """``(query_id, phrase, offset, term, phraseLen, phrases)`` of a table of queries. A query with a
    word that has no token is left out: it matches nothing."""
    clean = F.trim(F.regexp_replace(F.col(text), r"(?U)\s+", " "))
    words = queries.select(F.col(query_id).alias("query_id"), F.posexplode(F.split(clean, " ")).alias("phrase", "word"))
    toks = words.select("query_id", "phrase", raw_tokens(F.regexp_replace("word", '"', "")).alias("tokens"))
    if stem:
        toks = toks.withColumn("tokens", stem_tokens("tokens"))
    whole = Window.partitionBy("query_id")
    return (toks.withColumn("phraseLen", F.size("tokens"))
            .withColumn("phrases", F.count(F.lit(1)).over(whole))
            .withColumn("__min", F.min("phraseLen").over(whole)).filter("__min > 0")
            .select("query_id", "phrase", "phraseLen", "phrases", "tokens",
                    F.posexplode("tokens").alias("offset", "term")))


def search_many(index: TextIndex, queries: DataFrame, limit: int = 50, query_id: str = "query_id",
                text: str = "text") -> DataFrame:
    """``(query_id, id, rank, position)``: the ``limit`` best rows of every query of a table.

    All phrases must occur, so the rows that hold a query's rarest term are its only candidates;
    the other terms are looked up for those rows alone.
    """
    phrases = stored(query_phrases(queries, index.stem, query_id, text))
    n_phrases = phrases.count()
    # The queries' side has at most a row for each word of a query; counted, it is broadcast, so that postings stay
    # where they are. With too many queries Spark joins them by shuffle.
    few = F.broadcast if n_phrases <= BROADCAST_ROWS else (lambda df: df)
    terms = phrases.select("term").distinct()
    hits = index.of_buckets(terms).join(few(terms), "term", "left_semi")
    # Read three times below: frequencies, candidates, weights.
    doc_terms = stored(hits.select("id", "term", F.col("tf").cast("long").alias("tf"), "len"))
    term_df = stored(doc_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    rare = (phrases.join(few(term_df), "term", "left")
            .groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term")))
    candidates = doc_terms.join(few(rare), "term").select("query_id", "id")

    # Frequencies join the few query terms, not the many rows.
    single = (phrases.filter("phraseLen = 1").join(term_df, "term")
              .select("query_id", "phrase", "phrases", "term", "df"))
    single_tf = (candidates.join(few(single), "query_id").join(doc_terms, ["id", "term"])
                 .select("query_id", "id", "phrase", "phrases", "tf", "df", "len"))

    # Phrases of several tokens: occurrences are found once per distinct phrase.
    multi = phrases.filter("phraseLen > 1")
    distinct_multi = multi.select("tokens", "phraseLen", "offset", "term").distinct()
    places = hits.join(few(distinct_multi.select("term").distinct()), "term", "left_semi").select("id", "len", "term", F.explode(positions("at")).alias("pos"))
    starts = (places.join(few(distinct_multi), "term")
              .groupBy("tokens", "id", "len", (F.col("pos") - F.col("offset")).alias("s"))
              .agg(F.count(F.lit(1)).alias("c"), F.first("phraseLen").alias("n")).filter("c = n"))
    multi_tf = starts.groupBy("tokens", "id", "len").agg(F.count(F.lit(1)).alias("tf"))
    multi_df = multi_tf.groupBy("tokens").agg(F.count(F.lit(1)).alias("df"))
    multi_rows = (candidates.join(few(multi.filter("offset = 0").select("query_id", "phrase", "phrases", "tokens")), "query_id")
                  .join(multi_tf, ["id", "tokens"]).join(multi_df, "tokens")
                  .select("query_id", "id", "phrase", "phrases", "tf", "df", "len"))

    found = single_tf.unionByName(multi_rows).withColumn("__c", index._corpus()).select("*", "__c.*")
    w = _idf(F.col("rows"), F.col("df")) * _weight(F.col("tf"), F.col("len"), F.col("mean"))
    ranked = (found.groupBy("query_id", "id")
              .agg(F.count(F.lit(1)).alias("n"), F.first("phrases").alias("phrases"), F.sum(w).alias("w"))
              .filter("n = phrases").select("query_id", "id", (-F.col("w")).alias("rank")))
    per_query = Window.partitionBy("query_id").orderBy("rank", "id")
    return ranked.withColumn("position", F.row_number().over(per_query)).filter(F.col("position") <= limit)


def bm25_score(tf: float, df: int, rows: int, length: float, mean: float) -> float:
    """The formula for one phrase, for checks by hand."""
    idf = math.log((rows - df + 0.5) / (df + 0.5))
    return (idf if idf > 0 else IDF_FLOOR) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
