"""Secret scans with a trigram inverted index. DataFrame functions only.

``index`` is the inverted index: one posting (trigram, text key) for each trigram of the rules' queries that
a text has in lower case. ``candidates`` intersects the postings of each conjunction of a rule's query and
unites the conjunctions. ``scan`` verifies candidates with the rule's regular expression; rules whose query
says nothing (no mandatory trigram) look at every text.

Matches are leftmost and not overlapping within a kind; then those that fail the rule's least length go.
Positions count code points, ends are exclusive. Defined cases: a null text is an empty one; repeated rows
share postings and each gets its spans; texts are scanned whole; an empty table gives no rows; columns not
named in ``keep`` are ignored. The work of one text grows with the square of its matches (they are
numbered by an array fold, which copies what it has so far): some 5 s for ten thousand, 90 s for forty thousand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscribe.llm import common, trigrams


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|"""
         r"""(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
#: Kinds that the index makes cheap to add.
MORE = (
    Rule("forge", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("cloud", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("key", "-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
)
RULES = BASE + MORE
SPAN = "struct<start:int,number:int,kind:string,end:int>"


def _key(df: DataFrame, doc_id: str, text: Column) -> list[Column]:
    """A text's key in the index. Rows that share it have the same text, so the same matches."""
    return [F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("key_id"), F.xxhash64(text).alias("key_hash")]


def index(docs: DataFrame, wanted: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (trigram, key_id, key_hash) of the wanted trigrams; trigram is its place in ``wanted``."""
    whole = common.text_of(docs, text)
    low = docs.select(*_key(docs, doc_id, whole), F.lower(whole).alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(wanted)]))
    return low.select("key_id", "key_hash", F.explode(has).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_id, key_hash, rules): the rules, as bits, whose trigram query a text meets. Rules without a
    mandatory trigram are not among them."""
    queries = {n: trigrams.of(r.pattern) for n, r in enumerate(rules)}
    parts = [(n, sorted(c)) for n, q in queries.items() if q != trigrams.ANY for c in sorted(map(sorted, q))]
    wanted = sorted({t for _, c in parts for t in c})
    spark = docs.sparkSession
    if not wanted:
        return spark.createDataFrame([], "key_id string, key_hash bigint, rules bigint")
    # A few rows that follow from the rules alone.
    uses = spark.createDataFrame([(p, 1 << n, wanted.index(t), 1 << k, (1 << len(c)) - 1)
                                  for p, (n, c) in enumerate(parts) for k, t in enumerate(c)],
                                 "part int, rule bigint, trigram int, bit bigint, full bigint")
    met = index(docs, wanted, doc_id, text).join(F.broadcast(uses), "trigram").groupBy(
        "key_id", "key_hash", "part", "rule", "full").agg(F.bit_or("bit").alias("bits"))
    return met.filter("bits = full").groupBy("key_id", "key_hash").agg(
        F.bit_or("rule").alias("rules"))


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """Spans of one rule in a text: what is between the matches and the matches themselves, added up."""
    pattern = F.lit(rule.pattern)
    if rule.group == 0 and rule.least > 1 and rule.pattern.endswith("]+"):
        # The last class takes all it can, so that a match that is too short hides no longer one.
        pattern = F.lit(_at_least(rule))
    between = F.transform(F.split(text, pattern, -1), lambda s: F.char_length(s))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    empty = F.array().cast(f"array<{SPAN}>")

    def step(at, pair):
        start = at["at"] + pair["between"]
        end = start + F.char_length(pair["found"])
        part = pair["found"] if rule.group == 0 else F.regexp_extract(pair["found"], rule.pattern, rule.group)
        one = F.struct(start.alias("start"), F.lit(number).alias("number"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        good = F.char_length(part) >= rule.least
        return F.struct(end.alias("at"), F.when(good, F.concat(at["spans"], F.array(one))).otherwise(at["spans"]).alias("spans"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(b.alias("between"), m.alias("found")))
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda s: s["spans"])
    return F.when(F.rlike(text, pattern), spans).otherwise(empty)


def _at_least(rule: Rule) -> str:
    """``head[class]+`` with so many of the class that the match has the least length, if the head is plain."""
    cut = rule.pattern.rindex("[")
    head = rule.pattern[:cut]
    if head and not head.isalnum():
        return rule.pattern
    return f"{rule.pattern[:-1]}{{{rule.least - len(head)},}}"


def scan(docs: DataFrame, keep: list[str], rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``spans``, an array of (start, number, kind, end) in order of start and rule."""
    out = _scanned(docs, keep, rules, doc_id, text)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "spans")


def _scanned(docs: DataFrame, keep: list[str], rules, doc_id: str, text: str) -> DataFrame:
    """As ``scan``, with the kept columns as c0, c1, ... and the text as ``whole``."""
    whole = common.text_of(docs, text)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], whole.alias("whole"), *_key(docs, doc_id, whole))
    rows = rows.join(candidates(docs, rules, doc_id, text), ["key_id", "key_hash"], "left")
    empty = F.array().cast(f"array<{SPAN}>")
    parts = []
    for n, rule in enumerate(rules):
        found = _spans(F.col("whole"), n, rule)
        if trigrams.of(rule.pattern) != trigrams.ANY:
            found = F.when(F.col("rules").bitwiseAND(F.lit(1 << n)) != 0, found).otherwise(empty)
        parts.append(found)
    return rows.withColumn("spans", F.array_sort(F.concat(*parts)))


def redact(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """``docs`` with each secret replaced by its kind in angle brackets; overlapping ones become one. Where
    there is a column ``size``, it counts the characters of a changed text."""
    rows = _scanned(docs, docs.columns, rules, doc_id, text)
    merged = F.expr(f"""aggregate(spans, cast(array() as array<{SPAN}>), (a, s) -> CASE
        WHEN size(a) > 0 AND a[size(a) - 1].end > s.start THEN concat(slice(a, 1, size(a) - 1), array(named_struct(
            'start', a[size(a) - 1].start, 'number', a[size(a) - 1].number, 'kind', a[size(a) - 1].kind,
            'end', greatest(a[size(a) - 1].end, s.end))))
        ELSE concat(a, array(s)) END)""")
    clean = F.expr("""concat(array_join(transform(m, (s, i) -> concat(
        substring(whole, IF(i = 0, 0, m[i - 1].end) + 1, s.start - IF(i = 0, 0, m[i - 1].end)), '<', s.kind, '>')), ''),
        substring(whole, m[size(m) - 1].end + 1))""")
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = rows.withColumn("m", merged).withColumn("clean", F.when(F.size("spans") > 0, clean))
    out = []
    for f in docs.schema.fields:
        c = F.col(at[f.name])
        if f.name == text:
            c = F.coalesce("clean", c)
        elif f.name == size:
            c = F.when(F.col("clean").isNotNull(), F.char_length("clean").cast(f.dataType)).otherwise(c)
        out.append(c.alias(f.name))
    return rows.select(*out)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
