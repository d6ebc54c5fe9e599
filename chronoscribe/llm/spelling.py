"""Spelling variants: words at an edit distance of one, found through an index of variable-length grams.

A word is written between two marks, and from each place a gram begins with two symbols and is extended while the gram so
far is frequent, up to ``LONGEST`` symbols. The dictionary is therefore the frequent grams (which occur in more than ``FREQUENT``
words): a rare short gram is selective and stays as it is, a frequent one is split up by what follows.

One edit changes only the grams whose symbols it touches: where a gram ends depends on its own symbols alone. The most grams
that cover one place are the word's bound of affected grams. A word near to another keeps all other grams, so of any
``bound + 1`` of its grams at least one is shared; each word goes to the index with the lists of its ``bound + 1`` rarest
ones only. A shared gram stands left of the edit, then it has the same place from the start in both words, or right of
it, then from the end; that place and the lengths are part of the key. Candidates are verified by their distance.

Since a gram is at most as long as the shortest word, a word always has more grams than one edit can affect, so no pair
is lost.

Defined cases: a null text has no words; a null id counts as an empty one; repeated rows count each; a table without words that
often gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscribe.llm import common

#: Letters of words: A-Z, a-z and the Latin-1 letters' block.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Grams of more words than this are extended.
FREQUENT = 50
SHORTEST, LONGEST = 2, 6
#: Code points of a word that is carried by its hash.
LONG = 64
#: Marks before and after a word; no letters.
_FIRST, _LAST = "^", "$"
#: For every join here: both sides grow with the vocabulary, and Spark takes a table for about as large as the compressed file that it comes
#: from, however many grams a word is exploded into. So it would broadcast what the driver cannot hold.
_BOTH_LARGE = "merge"


def words(docs: DataFrame, least_length: int = 6, least_n: int = 5, doc_id: str = "doc_id", text: str = "text",
          misspelt: Column | None = None) -> DataFrame:
    """(word, n): words of at least ``least_length`` code points that occur at least ``least_n`` times, stored.

    A run of letters loses one code point where ``misspelt``, a condition on columns ``h`` (crc32 of ``<id>:<run>``) and
    ``run``, is true: the one at ``h % length``."""
    runs = F.regexp_extract_all(F.translate(common.text_of(docs, text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(docs[doc_id].cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if misspelt is None:
        rows = rows.select(F.col("run").alias("word"))
    else:
        rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.char_length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.expr("substring(run, cast(h % char_length(run) as int) + 2)"))
        rows = rows.select(F.when(misspelt, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least_length)
    return common.cut(rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n))


def _key(word: Column) -> Column:
    """The word, or for a long one its SHA-256 behind a sign that is no letter: grams do not carry long words about."""
    return F.when(F.char_length(word) <= LONG, word).otherwise(F.concat(F.lit("#"), F.sha2(word, 256)))


def decompose(vocabulary: DataFrame, frequent: int = FREQUENT, longest: int = LONGEST) -> DataFrame:
    """(key, n, size, grams, affected): the variable-length grams of each word in order of their places, as (place, gram,
    lists), where ``lists`` counts the places of all words with the gram's symbols, and the bound of grams that one edit can
    affect. Stored."""
    symbols = F.split(F.concat(F.lit(_FIRST), "word", F.lit(_LAST)), "")
    marked = vocabulary.select(_key(F.col("word")).alias("key"), "n", (F.char_length("word") + 2).alias("size"), symbols.alias("symbols"))
    spans = F.flatten(F.transform(F.expr(f"sequence(1, size - {SHORTEST - 1})"), lambda p: F.transform(
        F.sequence(F.lit(SHORTEST), F.least(F.lit(longest), F.col("size") - p + 1)),
        lambda k: F.struct(p.alias("place"), k.alias("k"), F.array_join(F.slice("symbols", p, k), "").alias("gram")))))
    every = marked.select("key", "n", "size", F.explode(spans).alias("s")).select("key", "n", "size", "s.*")
    lists = every.groupBy("gram").agg(F.count(F.lit(1)).alias("lists"))
    # The word's place in the shuffle serves both groupings.
    rows = every.join(lists.hint(_BOTH_LARGE), "gram").repartition("key")
    here = rows.groupBy("key", "n", "size", "place").agg(F.sort_array(F.collect_list(F.struct("k", "gram", "lists"))).alias("steps"))
    chosen = F.coalesce(F.get(F.filter("steps", lambda s: s["lists"] <= frequent), F.lit(0)), F.element_at("steps", -1))
    here = here.select("key", "n", "size", "place", chosen.alias("g"))
    whole = here.groupBy("key", "n", "size").agg(F.sort_array(F.collect_list(
        F.struct("place", F.col("g.gram").alias("gram"), F.col("g.lists").alias("lists")))).alias("grams"))
    # Grams that cover place i begin at most ``longest - 1`` places before it.
    cover = F.transform(F.expr("sequence(1, size)"), lambda i: F.size(F.filter(
        F.slice("grams", F.greatest(i - longest + 1, F.lit(1)), F.least(i, F.lit(longest))), lambda g: g["place"] + F.char_length(g["gram"]) > i)))
    return common.cut(whole.withColumn("affected", F.array_max(cover)))


def near_pairs(vocabulary: DataFrame, frequent: int = FREQUENT, longest: int = LONGEST) -> DataFrame:
    """(a, b, n_a, n_b): words that differ by exactly one inserted, deleted or replaced code point; a pair stands once. ``longest`` is
    at most the length of the shortest word."""
    index = decompose(vocabulary, frequent, longest)
    rarest = F.slice(F.sort_array(F.transform("grams", lambda g: F.struct(g["lists"], g["gram"], g["place"]))), F.lit(1), F.col("affected") + 1)
    lists = index.select("key", "n", "size", F.explode(rarest).alias("g")).select("key", "n", "size", "g.gram", "g.place")
    # Left of the edit the place counts from the start, right of it from the end.
    keyed = lists.select("key", "n", "size", "gram", F.explode(F.array(F.col("place"), F.col("place") - F.col("size"))).alias("side"))
    probe = keyed.select(F.col("key").alias("a"), F.col("n").alias("n_a"), "gram", "side", F.explode(F.expr("array(size, size + 1)")).alias("size"), F.col("size").alias("own"))
    long = F.col("a").startswith("#") | F.col("b").startswith("#")
    met = probe.join(keyed.withColumnsRenamed({"key": "b", "n": "n_b"}).hint(_BOTH_LARGE), ["gram", "side", "size"]).where(
        ((F.col("own") < F.col("size")) | (F.col("a") < F.col("b"))) & (long | (F.levenshtein("a", "b", 1) == 1)))
    met = common.cut(met.select("a", "b", "n_a", "n_b").distinct())
    whole = vocabulary.where(F.char_length("word") > LONG).select(_key(F.col("word")).alias("key"), "word")
    for side in ("a", "b"):
        texts = whole.select(F.col("key").alias(side), F.col("word").alias(f"{side}_word"))
        met = met.join(texts.hint(_BOTH_LARGE), side, "left")
    met = met.withColumns({c: F.coalesce(f"{c}_word", c) for c in ("a", "b")})
    return met.where(~(F.col("a_word").isNotNull() | F.col("b_word").isNotNull()) | (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "n_a", "n_b")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the chain word, form, form of the form ...; by doubling. ``forms`` is (word, form) with
    every form a word that occurs more often, so a chain has no circle."""
    step = common.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        # Both sides hold only words that have a form.
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = common.cut(step.join(ahead.hint(_BOTH_LARGE), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        step = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return step


def variants(vocabulary: DataFrame, times: int = 5, frequent: int = FREQUENT, longest: int = LONGEST) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a word's form is its near word that occurs most often (ties: the smallest in
    code-point order), if it does at least ``times`` as often as the word; else null."""
    pairs = near_pairs(vocabulary, frequent, longest)
    both = pairs.select(F.expr("inline(array(struct(a as word, n_a as n, b as near, n_b as near_n), struct(b as word, n_b as n, a as near, n_a as near_n)))"))
    best = common.cut(both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")).select(
        "word", "n_near", F.when(-F.col("best.less") >= times * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f")))
    roots = follow(best.where("f IS NOT NULL").select("word", "f.form"))
    return vocabulary.join(best.hint(_BOTH_LARGE), "word", "left").join(roots.hint(_BOTH_LARGE), "word", "left").select(
        "word", "f.form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "f.form_n")
