"""N-gram Jaccard join by prefix trees.

A document is the set of its distinct ``n_words``-word shingles (hashes). All sets are kept in one global order, shingles
that look frequent last. Two documents link when 100 * intersection >= ``percent`` * union. The defaults
``N`` and ``PERCENT`` are op7's.

* Documents of one set are one node. ``features`` gives each node its prefix: the shingles of which a partner
  must share one.
* Candidates come in two rounds. The first takes the nodes that share one of a few minima of the set and pairs each with the
  most central among them: that connects groups of near copies without listing their pairs. The second takes all
  nodes that share a prefix shingle and are not yet connected, so no link between two components is lost, whatever the
  size of the groups.
  Pairs must fit in length, in the number of prefix shingles they share, and in the parity of 1,024 bits, which differs in at most
  as many bits as the sets differ in shingles.
  Pairs within a component are left out, so by default the join gives connectivity only. With ``links=True`` there is one
  round over all nodes that share a prefix shingle; every link between different sets is verified and counted.
* ``linked`` verifies: the candidates of one probe stand in a prefix tree in global order; it is traversed with the probe's set,
  sharing the overlap of common prefixes, and a subtree is left when what remains of either set cannot reach
  the overlap that is needed.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z became lower case. Defined cases: fewer than ``n_words`` words are one shingle, a text without
words or a null text is an empty set and linked with nothing; repeated rows and ids share a component if their sets
link; a null id joins a component but never names it, and a component of null ids has a null name; texts are taken whole; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscribe.llm import common
from chronoscribe.llm.graph import components

N, PERCENT = 4, 85
MINIMA, PARITY = 4, 1024
#: Slots of the table of frequent shingles, which orders them: 16 MiB at any size. It never decides about a link.
SLOTS = 1 << 24
#: A shingle is frequent where so many texts of a chunk of so many shingles have it.
OFTEN, CHUNK = 3, 4 << 20
#: Candidates that one prefix tree holds; a probe with more is dealt to several.
TREE = 256
#: Asked texts are broadcast by their ids up to this counted number (some 10 MB); beyond it texts are shuffled to them.
BROADCAST_ROWS = 200_000
#: Nodes with one prefix shingle that are a crowd, and how many of them one task takes on one side.
CROWD, SHARE = 32, 4096
_SIGN = [f"s{i}" for i in range(PARITY // 64)]


def shingles(data: np.ndarray, off: np.ndarray, n_words: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text, with repeats, and their text numbers."""
    data = common.folded(data)
    starts, ends, text = common.runs(~common.blank(data), off)
    spans = common.Spans(common.Spans(data).of(starts, ends))
    grams = spans.grams(n_words)
    whole = text[:len(grams)] == text[n_words - 1:] if len(grams) else np.zeros(0, bool)
    n = len(off) - 1
    count = np.bincount(text, minlength=n)
    short = np.flatnonzero((count > 0) & (count < n_words))
    first = np.searchsorted(text, short)
    return (np.concatenate([grams[whole], spans.of(first, first + count[short])]),
            np.concatenate([text[:len(grams)][whole], short]))


def ordered_sets(data: np.ndarray, off: np.ndarray, classes: np.ndarray, n_words: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts in global order within each text, and the texts' edges. The four highest bits
    are the class of frequency, the others the hash."""
    h, text = shingles(data, off, n_words)
    token = (h >> np.uint64(4)) | (classes[h & np.uint64(SLOTS - 1)].astype(np.uint64) << np.uint64(60))
    order = np.lexsort((token, text))
    token, text = token[order], text[order]
    new = np.append(True, (token[1:] != token[:-1]) | (text[1:] != text[:-1])) if len(token) else np.zeros(0, bool)
    token, text = token[new], text[new]
    return token, np.searchsorted(text, np.arange(len(off)))


def _classes(docs: DataFrame, n_words: int) -> np.ndarray:
    """The class of frequency of each slot, from the shingles that several texts of some chunk have. The driver gets at most
    SLOTS bytes."""
    def run(batches):
        held, size = [], 0

        def emit():
            hot, n = np.unique(np.concatenate(held), return_counts=True)
            hot, n = hot[n >= OFTEN], n[n >= OFTEN]
            return pa.RecordBatch.from_arrays([pa.array((hot & np.uint64(SLOTS - 1)).astype(np.int64)), pa.array(n)], ["slot", "n"])

        for piece in common.pieces(batches, "text"):
            h, text = shingles(*common.raw(common.column(piece, "text")), n_words)
            once = np.unique(common.within(h, text), return_index=True)[1]
            held.append(h[once])
            size += len(once)
            if size >= CHUNK:
                yield emit()
                held, size = [], 0
        if held:
            yield emit()

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = np.zeros(4096, np.uint8)
        part[table.column("slot").to_numpy() & 4095] = np.minimum(15, 1 + np.log2(table.column("n").to_numpy()) / 2)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "classes": pa.array([part.tobytes()], pa.binary())})

    rows = docs.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    parts = rows.withColumn("part", F.shiftright("slot", 12)).groupBy("part").applyInArrow(pack, "part bigint, classes binary").collect()
    classes = np.zeros(SLOTS, np.uint8)
    for r in parts:
        classes[r["part"] * 4096:(r["part"] + 1) * 4096] = np.frombuffer(r["classes"], np.uint8)
    return classes


def _features(docs: DataFrame, classes, n_words: int, percent: int) -> DataFrame:
    """A stored table with one row for each document row. Only the first of a piece's equal sets has a prefix."""
    rows = docs.withColumn("node", F.monotonically_increasing_id())

    def run(batches):
        for piece in common.pieces(batches, "text"):
            n = piece.num_rows
            token, edge = ordered_sets(*common.raw(common.column(piece, "text")), classes.value, n_words)
            size = np.diff(edge)
            text = np.repeat(np.arange(n), size)
            full = size > 0
            digest = []
            for seed in (1, 2):
                h = common.mix(token + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(h, out=total[1:])
                digest.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
            minima = np.zeros((n, MINIMA), np.uint64)
            for k in range(MINIMA):
                h = common.mix(token ^ np.uint64((k + 3) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
                minima[full, k] = np.minimum.reduceat(h, edge[:-1][full]) if full.any() else 0
            bit = (common.mix(token + np.uint64(77)) & np.uint64(PARITY - 1)).astype(np.int64)
            parity = (np.bincount(text * PARITY + bit, minlength=n * PARITY) & 1).astype(np.uint8).reshape(n, PARITY)
            sign = np.packbits(parity, axis=1).view("<i8").reshape(n, -1)
            first = np.zeros(n, bool)
            first[np.unique(digest[0], return_index=True)[1]] = True
            first &= full
            length = np.where(first, size - (percent * size + 99) // 100 + 1, 0)
            ends = np.concatenate([[0], np.cumsum(length)])
            at = np.arange(ends[-1]) - np.repeat(ends[:-1] - edge[:-1], length)
            yield pa.RecordBatch.from_arrays(
                [common.column(piece, "node"), common.column(piece, "doc_id"), common.column(piece, "hash"), pa.array(size),
                 pa.array(np.bincount(text[token < np.uint64(1 << 60)], minlength=n)), pa.array(digest[0]), pa.array(digest[1]),
                 pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * MINIMA).astype(np.int32)), pa.array(minima.reshape(-1).view(np.int64))),
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(token[at].view(np.int64))),
                 *[pa.array(np.ascontiguousarray(sign[:, i])) for i in range(len(_SIGN))]],
                ["node", "doc_id", "hash", "n", "rare", "h1", "h2", "minima", "prefix", *_SIGN])

    kind = ("node bigint, doc_id bigint, hash bigint, n bigint, rare bigint, h1 bigint, h2 bigint, minima array<bigint>, prefix array<bigint>, "
            + ", ".join(f"{s} bigint" for s in _SIGN))
    return common.cut(rows.mapInArrow(run, kind))


def fits(n: Column, m: Column, percent: int = PERCENT) -> Column:
    """Set sizes of which one can be the needed part of the other."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _alike(n: Column, m: Column, a: str, b: str, percent: int) -> Column:
    """Parities that differ in no more bits than the sets may in shingles."""
    differ = sum((F.bit_count(F.col(a.format(s)).bitwiseXOR(F.col(b.format(s)))) for s in _SIGN), F.lit(0))
    # |A xor B| = |A| + |B| - 2 * I and I * (100 + percent) >= percent * (|A| + |B|)
    return differ * (100 + percent) <= (n + m) * (100 - percent)


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes fit and whose parities allow a link."""
    sign = lambda side: nodes.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), *[F.col(s).alias(f"{side}_{s}") for s in _SIGN])
    both = pairs.hint("merge").join(sign("a"), "a").hint("merge").join(sign("b"), "b")
    return both.filter(fits(F.col("a_n"), F.col("b_n"), percent) & _alike(F.col("a_n"), F.col("b_n"), "a_{}", "b_{}", percent)).select("a", "b")


def tree_links(probe: np.ndarray, members: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Places of the members that link with the probe. The members, in lexicographic order, are the paths of a prefix tree; what the
    probe shares with a path's start is kept for the next path that has the same start."""
    keys = [m.astype(">u8").tobytes() for m in members]
    found, shared, before = [], np.zeros(1, np.int64), np.zeros(0, np.uint64)
    for i in sorted(range(len(members)), key=keys.__getitem__):
        m = members[i]
        total = len(probe) + len(m)
        need = -(-percent * total // (100 + percent))
        common_size = min(len(before), len(m), len(shared) - 1)
        differs = np.flatnonzero(before[:common_size] != m[:common_size])
        at = int(differs[0]) if len(differs) else common_size
        shared, before = shared[:at + 1], m
        left_out = False
        while True:
            reach = int(np.searchsorted(probe, m[at - 1], "right")) if at else 0
            if shared[at] + min(len(m) - at, len(probe) - reach) < need:
                left_out = True
                break
            if at >= len(m):
                break
            step = m[at:at + 64]
            place = np.minimum(np.searchsorted(probe, step), len(probe) - 1)
            shared = np.concatenate([shared, shared[at] + np.cumsum(probe[place] == step)])
            at += len(step)
        if not left_out and shared[len(m)] * (100 + percent) >= percent * total:
            found.append(i)
    return found


def linked(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, classes, n_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the whole sets of their texts: ``rows`` (doc_id, hash, text)."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TREE).alias("trees"))
    pairs = pairs.hint("merge").join(parts, "a").select("a", "b", F.pmod(F.hash("b"), F.col("trees")).cast("int").alias("tree"))
    asked = pairs.select("a", "tree", F.col("b").alias("node")).union(pairs.select("a", "tree", F.col("a")).distinct())
    asked = common.cut(asked.hint("merge").join(nodes.select("node", F.col("doc_id").alias("d"), F.col("hash").alias("h")), "node"))
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    rows = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))).select("a", "tree", "node", "text")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "a", "tree").sortWithinPartitions("a", "tree")

    def run(batches):
        held, key = {}, None

        def done():
            probe = held.pop(key[0])
            names = list(held)
            return [(key[0], names[i]) for i in tree_links(probe, [held[x] for x in names], percent)]

        out = []
        for piece in common.pieces(batches, "text"):
            token, edge = ordered_sets(*common.raw(common.column(piece, "text")), classes.value, n_words)
            for i, (a, tree, node) in enumerate(zip(*(common.column(piece, c).to_pylist() for c in ("a", "tree", "node")))):
                if key != (a, tree):
                    if key:
                        out += done()
                    held, key = {}, (a, tree)
                held[node] = token[edge[i]:edge[i + 1]].copy()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
            out = []
        if key:
            out = done()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _meeting(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, n, component, prefix, parities) of different components whose prefixes share what they must."""
    # What two prefixes share is counted: a set of n whose partner has
    # m shares at least I = ceil(percent * (n + m) / (100 + percent)), so of its prefix at most n - I shingles are not the partner's, and
    # the prefix that ends first in the global order has all others in common with the other prefix.
    at = nodes.select("node", "n", "component", F.posexplode("prefix").alias("place", "token"))
    crowds = common.cut(at.groupBy("token").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > CROWD)
                        .select("token", F.ceil(F.col("members") / SHARE).cast("int").alias("shares")))

    def shift(x: str, y: str) -> Column:
        """What stands before a common shingle in one set and not in the other is at most n - I."""
        return ((F.col(f"{x}.place") - F.col(f"{y}.place")) * (100 + percent)
                <= 100 * F.col(f"{x}.n") - percent * F.col(f"{y}.n"))

    together = ((F.col("l.token") == F.col("r.token")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.component") != F.col("r.component"))
                & fits(F.col("l.n"), F.col("r.n"), percent) & shift("l", "r") & shift("r", "l"))
    few = at.join(crowds, "token", "left_anti")
    # Members of a crowd bring their parities: pairs that cannot link are not made. A crowd is dealt to several tasks.
    if crowds.count() <= BROADCAST_ROWS:
        signed = nodes.select("node", "n", "component", *_SIGN, F.posexplode("prefix").alias("place", "token"))
        many = signed.join(F.broadcast(crowds), "token")
    else:
        many = common.cut(at.join(crowds, "token").join(nodes.select("node", *_SIGN), "node"))
    left = many.withColumn("share", F.pmod(F.hash("node"), F.col("shares"))).drop("shares")
    right = many.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    columns = [F.col("l.node").alias("a"), F.col("r.node").alias("b"), F.col("l.n").alias("n"), F.col("r.n").alias("m")]
    meet = few.alias("l").hint("merge").join(few.alias("r"), together).select(*columns).union(
        left.alias("l").hint("merge").join(right.alias("r"), together & (F.col("l.share") == F.col("r.share"))
                                           & _alike(F.col("l.n"), F.col("r.n"), "l.{}", "r.{}", percent)).select(*columns))
    shared = meet.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
    need = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent) - 1e-6) - F.ceil(F.greatest("n", "m") * percent / 100 - 1e-6) + 1
    return shared.filter(F.col("shared") >= need).select("a", "b")


def _connected(nodes: DataFrame, rows: DataFrame, classes, n_words: int, percent: int) -> DataFrame:
    """(node, component) by the two rounds, which verify no pair that is connected already."""
    # First round: of the nodes that share a minimum, the one with the fewest shingles of its own. In a large group of near
    # copies the shingles that edits made are rare and those of the original are not, so that is the original.
    minima = nodes.select("node", "rare", F.posexplode("minima").alias("k", "value"))
    least = minima.groupBy("k", "value").agg(F.min(F.struct("rare", "node"))["node"].alias("a"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    stars = minima.hint("merge").join(least, ["k", "value"]).filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    first = common.cut(linked(common.cut(_near(stars, nodes, percent)), rows, nodes, classes, n_words, percent))
    known = components(first)

    # Second round: prefixes that meet across components.
    at = nodes.select("node", "n", "prefix", *_SIGN).join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    second = common.cut(linked(common.cut(_near(_meeting(at, percent), nodes, percent)), rows, nodes, classes, n_words, percent))
    return components(first.union(second))


def _rank(doc_id: str, text_hash: str) -> Column:
    """Rows by id, those without one last, then by the hash of the text."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(text_hash).alias("hash"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", links: bool = False, n_words: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, hash, first) per document row; ``hash`` is of the text, to find the row again, and ``first``
    tells the component's first row (by id, nulls last, then by hash) and its repetitions. With ``links`` also
    ``n_links``, the number of other rows that the row links with, rows of the same set among them; this verifies each pair of
    different sets that could link, within groups of near copies too, whose pairs grow with the square of their size. Runs jobs."""
    spark = docs.sparkSession
    whole = common.text_of(docs, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("hash"))
    classes = spark.sparkContext.broadcast(_classes(rows.select("text"), n_words))
    found = _features(rows, classes, n_words, percent)
    sets = found.filter("n > 0").groupBy("h1", "h2").agg(F.min(F.when(F.size("prefix") > 0, F.col("node"))).alias("node"),
                                                         F.min(_rank("doc_id", "hash")).alias("least"),
                                                         F.count(F.lit(1)).alias("rows"))
    sets = common.cut(sets)
    nodes = common.cut(found.join(sets.select("node"), "node", "left_semi").drop("h1", "h2"))

    if links:
        pairs = common.cut(_near(_meeting(nodes.withColumn("component", F.col("node")), percent), nodes, percent))
        every = common.cut(linked(pairs, rows, nodes, classes, n_words, percent))
        final = components(every)
        other = every.union(every.select("b", "a")).toDF("node", "other").join(sets.select(F.col("node").alias("other"), "rows"), "other")
        sets = sets.join(other.groupBy("node").agg(F.sum("rows").alias("linked")), "node", "left").withColumn(
            "n_links", F.coalesce("linked", F.lit(0)) + F.col("rows") - 1)
    else:
        final = _connected(nodes, rows, classes, n_words, percent)
    count = ["n_links"] if links else []
    named = sets.join(final, "node", "left").select("h1", "h2", "least", *count, F.coalesce("component", "node").alias("component"))
    lowest = named.groupBy("component").agg(F.min("least").alias("first"))
    of_set = named.join(lowest, "component").select("h1", "h2", "first", *count)
    out = found.select("doc_id", "hash", "n", F.when(F.col("n") > 0, F.col("h1")).alias("h1"), F.when(F.col("n") > 0, F.col("h2")).alias("h2"))
    joined = out.filter("n > 0").hint("merge").join(of_set, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), "hash", *count,
                                                                             (F.col("first") == _rank("doc_id", "hash")).alias("first"))
    alone = out.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "hash",
                                       *[F.lit(0).cast("long").alias(c) for c in count], F.lit(True).alias("first"))
    return joined.unionByName(alone)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``docs``, unchanged: the one with the least id (nulls last) and, of several, the least hash of the text."""
    keep = join(docs, doc_id, text, n_words=n_words, percent=percent).filter("first").select(
        F.col("doc_id").alias("keep_id"), F.col("hash").alias("keep_hash")).distinct()
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()], F.xxhash64(common.text_of(docs, text)).alias("hash"))
    met = rows.join(keep, F.col(names[doc_id]).cast("long").eqNullSafe(F.col("keep_id")) & (F.col("hash") == F.col("keep_hash")))
    return met.dropDuplicates([names[doc_id], "hash"]).select(*[F.col(a).alias(c) for c, a in names.items()])
