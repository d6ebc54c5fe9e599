"""Filter interaction audit: what each filter does in every order of the filters.

Each document is reduced to the set of filters that it fails, a bit mask. Applying filters in some order is
a walk up the lattice of filter sets: an edge (S, f) is the step that applies ``f`` when the filters of S have been
applied before, and it removes the documents that fail ``f`` and none of S. What an edge removes does not
depend on the order within S, so all orders are read from the edges of one table:

* ``edges``: for each part, set and next filter what is removed and kept there;
* forward counts say how many orders reach a set, backward counts how many complete it from there; their product is the
  number of orders that take an edge, and the Shapley sums weight the edge's removals with it;
* ``steps``: each order's path through the edges, with the removals at each step.

Documents are counted as (part, mask) groups before anything else, so a part of any size is at most 2**k rows.

Defined cases: a null text is an empty one; a null part is an empty string; a text is a repeat when the same text has a
smaller id anywhere in the table, so rows with a null id never are and never make others repeats, and of rows with the
same id and text all or none are; a document with several labels counts when one of them is 1, without an id or without
labels it counts as neither good nor toxic; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscribe.llm import common

#: White space of the word definition.
_SPACE = " \t\n\x0b\f\r"
#: Orders of k filters are k! rows a part.
MOST_FILTERS = 7


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that look at one text, by letter. Words are maximal runs without white space."""
    body = F.btrim(text, F.lit(_SPACE))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "[ \\t-\\r]+"))
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n_words < 200, "B": n_distinct * 100 < n_words * 50, "C": capitals.cast("long") * 100 > F.char_length(text).cast("long") * 2,
            "D": text.rlike("[#$%&*|]")}


def failures(docs: DataFrame, labels: DataFrame, part: str = "source", doc_id: str = "doc_id", text: str = "text",
             filters=text_filters, repeats: str | None = "E") -> tuple[DataFrame, list[str]]:
    """(part, mask, n, good, toxic): documents by the set of filters that they fail, and the letters of the mask's bits.

    ``filters`` maps the text column to failure conditions; ``repeats`` is the letter of the repeat filter, or None.
    The text itself is looked at once, where it is read; what is shuffled is its SHA-256."""
    whole = common.text_of(docs, text)
    said: Mapping[str, Column] = filters(whole)
    letters = [*said, *([repeats] if repeats else [])]
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters, their orders are all listed")
    mask = F.lit(0)
    for i, fails in enumerate(said.values()):
        mask = mask + F.when(fails, F.lit(1 << i)).otherwise(F.lit(0))
    key = F.unhex(F.sha2(whole, 256)) if repeats else F.lit(None).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), mask.alias("mask"), key.alias("key"))
    rows = common.cut(rows.groupBy("key", "doc", "part", "mask").agg(F.count(F.lit(1)).alias("n")))
    if repeats:
        # One row an id and text: neither a text of millions of documents nor its many copies meet in one task.
        first = rows.where("doc IS NOT NULL").groupBy("key").agg(F.min("doc").alias("doc"), F.lit(True).alias("first"))
        rows = rows.where("doc IS NOT NULL").join(first, ["key", "doc"], "left").select(
            "doc", "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << (len(letters) - 1))).alias("mask"), "n"
        ).unionByName(rows.where("doc IS NULL").select("doc", "part", "mask", "n"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("doc")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.where("good = 1 OR toxic = 1")
    # Rows without an id are added up first: they have no label to look for.
    known = rows.where("doc IS NOT NULL").join(marks, "doc", "left")
    nothing = rows.where("doc IS NULL").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    out = known.unionByName(nothing).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return out, letters


def path_counts(k: int) -> tuple[list[int], list[int]]:
    """Of the lattice of subsets of k filters: orders that reach each set from the empty one, and orders that lead from
    it to the full one. Each is summed over the edges into, or out of, the set."""
    full = (1 << k) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for s in range(full + 1):
        for f in range(k):
            if not s >> f & 1:
                reach[s | 1 << f] += reach[s]
    for s in range(full, -1, -1):
        for f in range(k):
            if not s >> f & 1:
                leave[s] += leave[s | 1 << f]
    return reach, leave


def edges(counts: DataFrame, k: int) -> DataFrame:
    """(part, state, filter, n_orders, removed, kept, good_lost, toxic_lost): one row for each part and lattice edge, zeros
    included. ``n_orders`` is the number of orders that take the edge."""
    reach, leave = path_counts(k)
    lattice = [(s, f, reach[s] * leave[s | 1 << f]) for s in range(1 << k) for f in range(k) if not s >> f & 1]
    listed = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(n).cast("long").alias("n_orders")) for s, f, n in lattice])
    rows = counts.withColumn("e", F.explode(listed)).select("part", "mask", "n", "good", "toxic", "e.*")
    alive = F.col("mask").bitwiseAND(F.col("state")) == 0
    hit = F.expr("shiftright(mask, filter) & 1") == 1
    total = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(F.lit(0))).cast("long")
    return rows.groupBy("part", "state", "filter", "n_orders").agg(
        total(alive & hit, "n").alias("removed"), total(alive & ~hit, "n").alias("kept"),
        total(alive & hit, "good").alias("good_lost"), total(alive & hit, "toxic").alias("toxic_lost"))


def effects(edge: DataFrame, k: int) -> DataFrame:
    """(part, filter, fails, unique_fails, shapley): a filter alone, after all others, and its removals summed over all orders."""
    last = F.col("state") == F.expr(f"{(1 << k) - 1} ^ shiftleft(1, filter)")
    return edge.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"), F.sum(F.when(last, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("n_orders")).alias("shapley"))


def steps(edge: DataFrame, letters: list[str]) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every
    order of the filters."""
    k = len(letters)
    per_filter = effects(edge, k)
    # An edge lies on several orders; each lists the places where it is taken.
    taken: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in permutations(range(k)):
        state = 0
        for i, f in enumerate(order):
            taken.setdefault((state, f), []).append(("".join(letters[x] for x in order), i + 1))
            state |= 1 << f
    places = edge.sparkSession.createDataFrame(
        [(s, f, o, i) for (s, f), uses in taken.items() for o, i in uses], "state int, filter int, filter_order string, step int")
    # k! * k rows, fixed by the number of filters.
    rows = edge.join(F.broadcast(places), ["state", "filter"]).join(per_filter, ["part", "filter"])
    letter = F.element_at(F.array(*map(F.lit, letters)), F.col("filter") + 1)
    return rows.select("part", "filter_order", "step", letter.alias("filter"), "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
                       "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", **names) -> DataFrame:
    """Every order's steps for each part; see ``steps``. Runs a job for the counts."""
    counts, letters = failures(docs, labels, part, **names)
    edge = common.cut(edges(counts, len(letters)))
    return steps(edge, letters)
