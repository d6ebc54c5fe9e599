"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoscribe.llm import audit, chat, common, packing, prefix_tree, quality, radix, secret, sentence, spelling, sql, tokens, warc, weighting, winnow

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, d: str) -> DataFrame:
            common.bounded(spark)
            return fn(spark, d)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql.strip()
        return fn
    return register


@query("op2_sentencepiece")
def op2(spark: SparkSession, d: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = sentence.encode(table(spark, d, "documents").select("doc_id", "text"), model).select("doc_id", "ids")
    out = sentence.decode(ids, model)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op5_token_files")
def op5(spark: SparkSession, d: str) -> DataFrame:
    manifest = tokens.write(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return tokens.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_warc")
def op6(spark: SparkSession, d: str) -> DataFrame:
    captures = warc.assemble(warc.write(table(spark, d, "pages")))
    return captures.select("page_id", "response.payload_bytes", "response.payload_digest", "response.record_type",
                           F.col("response.first_page_id").alias("refers_to"))


@query("op8_quality_rules", sql.quality_rules())
def op8(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.ledger(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ledger.*")
    base, full = quality.failed(F.col("failures"), "base-1"), quality.failed(F.col("failures"), quality.POLICY)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failures",
                       base.alias("base_failed"), (~base & ~full).alias("kept"))


@query("op9_winnowing", sql.winnowing())
def op9(spark: SparkSession, d: str) -> DataFrame:
    found = winnow.find(table(spark, d, "documents"), table(spark, d, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op1_secret_scans", sql.secrets())
def op1(spark: SparkSession, d: str) -> DataFrame:
    found = secret.scan(table(spark, d, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["number"] < len(secret.BASE))
    count = lambda n: F.size(F.filter("spans", lambda s: s["number"] == n)).cast("long")
    return found.select("doc_id", *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(secret.BASE)],
                        F.sha2(secret.listed(base), 256).alias("base_sha256"), secret.listed(F.col("spans")).alias("spans"))


@query("op3_context_tree_weighting")
def op3(spark: SparkSession, d: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2
    return weighting.score(table(spark, d, "documents"), ["doc_id"], held_out)


@query("op4_reply_trees", sql.chats())
def op4(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    made = chat.conversations(chat.chained(rows.unionByName(extra)))
    back = chat.read(made)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


@query("op10_radix_dedup")
def op10(spark: SparkSession, d: str) -> DataFrame:
    return radix.remove(table(spark, d, "documents"), ["doc_id"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_prefix_tree_join", sql.jaccard())
def op7(spark: SparkSession, d: str) -> DataFrame:
    return prefix_tree.join(table(spark, d, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op11_filter_audit", sql.filter_audit())
def op11(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op12_best_fit_packing")
def op12(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end=1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op13_spelling_variants", sql.spelling())
def op13(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = spelling.words(table(spark, d, "documents"), least_length=6, least_n=5, misspelt=F.col("h") % 199 == 0)
    return spelling.variants(vocabulary, times=5)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, d: str) -> DataFrame:
    return corpus_pipeline.run(spark, d)
