"""Reply trees to conversations.

Nodes are messages with a parent. Self-joins that double their reach give each node its root, its distance
from it and the score of all messages on the way (``climb``); leaves are ranked within their tree by the mean
score of their path (``best_leaves``); the same doubled joins list the nodes of the chosen paths (``walk``);
each path becomes one formatted conversation with a loss mask (``render``). ``read`` takes it apart again.

Format of a turn: ``### role: text</turn>`` and a line break. Inside texts and roles a backslash is doubled,
``#`` before ``##`` becomes ``\\h``, ``<`` before ``/turn>`` becomes ``\\l``; in roles ``:`` becomes ``\\c``. So no
mark can come from a text, and the escape is undone exactly.

Defined cases: a null text or role is an empty one; a parent that the tree does not have makes a root; nodes that
reach no root (cycles) are on no path; ties of scores go to the smaller leaf id; ties of turns in ``chained`` are
ordered by role and text, repeated rows are turns of their own; a null tree id is a tree; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoscribe.llm import common

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"


def chained(rows: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows in order of turn as a tree with one branch: each replies to the one before."""
    named = rows.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        common.text_of(rows, text).alias("text"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    named = named.withColumn("node", F.row_number().over(order).cast("long"))
    return named.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree_key, node, to, steps, total) for each node, ``to`` null where the way up has been summed to the root; and
    the tables (tree_key, node, to) of ancestors 1, 2, 4, ... steps up."""
    links = nodes.select("tree_key", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = links.select("tree_key", F.col("node").alias("parent"), F.lit(True).alias("known"))
    up = common.cut(links.join(known, ["tree_key", "parent"], "left").select(
        "tree_key", "node", F.when(F.col("known"), F.col("parent")).alias("to"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")))
    n, reach, jumps = up.count(), 1, []
    while not (open_ := up.filter("to IS NOT NULL")).isEmpty() and reach <= n:
        jumps.append(open_.select("tree_key", "node", "to"))
        above = up.select("tree_key", F.col("node").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("total").alias("sum"))
        up = common.cut(open_.join(above, ["tree_key", "to"]).select(
            "tree_key", "node", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"),
            (F.col("total") + F.col("sum")).alias("total")).unionByName(up.filter("to IS NULL")))
        reach *= 2
    return up, jumps


def best_leaves(nodes: DataFrame, up: DataFrame, best: int | None) -> DataFrame:
    """(tree_key, leaf, rank): leaves that reach a root, by mean score of their path; all of them where ``best`` is None."""
    parents = nodes.select("tree_key", F.col("parent").alias("node")).distinct()
    leaves = up.filter("to IS NULL").join(parents, ["tree_key", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree_key").orderBy(F.desc(F.col("total") / F.col("steps")), "node"))
    ranked = leaves.select("tree_key", F.col("node").alias("leaf"), rank.alias("rank"))
    return ranked if best is None else ranked.filter(F.col("rank") <= best)


def walk(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(tree_key, leaf, rank, node, back): the nodes of each path, ``back`` steps before its leaf."""
    path = leaves.select("tree_key", "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back"))
    for k, jump in enumerate(jumps):
        more = path.join(jump, ["tree_key", "node"]).select("tree_key", "leaf", "rank", F.col("to").alias("node"), F.col("back") + (1 << k))
        path = common.cut(path.union(more))
    return path


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(F.regexp_replace(out, "#(?=##)", "\\\\h"), "<(?=/turn>)", "\\\\l")
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


_UNDO = {"\\\\": "\\", "\\h": "#", "\\l": "<", "\\c": ":"}
_MARK = re.compile(r"\\[\\hlc]")
_TURN = re.compile(r"### (.*?): (.*?)</turn>\n", re.S)


def unescape(text: str) -> str:
    return _MARK.sub(lambda m: _UNDO[m[0]], text)


def conversations(nodes: DataFrame, best: int | None = 1, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(tree, leaf, rank, n_turns, formatted, mask) of the ``best`` paths of each tree. ``nodes``: tree, node, parent, score,
    role, text. ``mask`` has the (start, end) of each text under the loss, in code points of ``formatted``."""
    nodes = common.cut(nodes.select("tree", F.coalesce(F.col("tree").cast("string"), F.lit("\x00null")).alias("tree_key"), "node", "parent",
                                    "score", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), common.text_of(nodes).alias("text")))
    up, jumps = climb(nodes)
    path = walk(best_leaves(nodes, up, best), jumps)
    turns = path.join(nodes.select("tree", "tree_key", "node", "role", "text"), ["tree_key", "node"])
    head = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(COLON))
    turns = turns.withColumn("head", head).withColumn("body", escape(F.col("text")))
    turns = turns.withColumn("size", F.char_length("head") + F.char_length("body") + len(CLOSE))
    before = Window.partitionBy("tree_key", "leaf").orderBy(F.desc("back")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0)) + F.char_length("head")
    turns = turns.select("tree", "tree_key", "leaf", "rank", (-F.col("back")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
                         start.cast("long").alias("start"), (start + F.char_length("body")).cast("long").alias("end"),
                         (F.col("role") == loss_role).alias("loss"))
    # One conversation is one row, so its turns have to meet.
    whole = turns.groupBy("tree_key", "leaf", "rank").agg(
        F.first("tree").alias("tree"), F.array_sort(F.collect_list(F.struct("at", "piece", "start", "end", "loss"))).alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return whole.select("tree", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.piece", "").alias("formatted"),
                        mask.alias("mask"))


def read(rows: DataFrame) -> DataFrame:
    """(tree, leaf, turns, loss_text, formatted_chars): turns as (role, text) and all text under the mask, from ``formatted`` and ``mask``."""
    def run(batches):
        for piece in common.pieces(batches, "formatted"):
            out = []
            for r in piece.select(["formatted", "mask"]).to_pylist():
                text = r["formatted"]
                found = list(_TURN.finditer(text))
                if "".join(m[0] for m in found) != text:
                    raise ValueError("not a formatted conversation")
                out.append(([{"role": unescape(m[1]), "text": unescape(m[2])} for m in found],
                            "".join(unescape(text[s["start"]:s["end"]]) for s in r["mask"]), len(text)))
            turns, loss, size = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [common.column(piece, "tree"), common.column(piece, "leaf"),
                 pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array(loss, pa.string()),
                 pa.array(size, pa.int64())], ["tree", "leaf", "turns", "loss_text", "formatted_chars"])

    kind = rows.schema["tree"].dataType.simpleString()
    node = rows.schema["leaf"].dataType.simpleString()
    return rows.select("tree", "leaf", "formatted", "mask").mapInArrow(
        run, f"tree {kind}, leaf {node}, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars bigint")
