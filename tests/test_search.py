"""Search against SQLite's full-text index (standard library) on the same rows."""
import pathlib
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoscribe.functions.stems import porter, stem
from chronoscribe.operators import postings, search
from chronoscribe.plans import api, retrieve
from chronoscribe.sources import views
from helpers import at

FOLDER = "/root/testdata/sf0.001"
TEXTS = [
    "Running runs runner foo-bar baz", "foo bar in one field", "bar foo reversed", "Déjà vu café naïve",
    "the quick-brown foxes are jumping over connections", "connected connection connecting", "don't stop",
    "its is it", "日本語 text", "_under_score_ and punctuation!", "the the the", "generalization of relational hopping",
    "the end", "the start", "", "cat caf́e étude",
]


def words(text):
    return text.split()


def match(text):
    return " AND ".join('"' + w.replace('"', "") + '"' for w in words(text))


def sqlite_rank(rows, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(a, b, c, tokenize='porter unicode61')")
    con.executemany("INSERT INTO f(rowid, a, b, c) VALUES (?,?,?,?)", rows)
    got = con.execute("SELECT rowid, rank FROM f WHERE f MATCH ? ORDER BY rank, rowid", [match(query)]).fetchall()
    return {i: r for i, r in got}


QUERIES = ["foo-bar", "foo bar", "run", "the", "the the", "DEJA", "cafe", "connect the", "++", '"', 'foo ++', "don't",
           "is", "its", "under", "日本語", "relate", "generalize hop", "title", "T3 foo"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"Title T{i % 4}" if i % 3 else None, "App") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id long, fullOcrText string, windowTitle string, appName string")
    return rows, df.persist()


@pytest.mark.parametrize("query", QUERIES)
def test_rank_equals_fts5(docs, query):
    rows, df = docs
    expected = sqlite_rank(rows, query)
    got = {r.id: r["rank"] for r in search.rank_documents(df, search.CAPTURE_FIELDS, search.parse_query(query)).collect()}
    assert got.keys() == expected.keys()
    for i in got:
        assert got[i] == pytest.approx(expected[i], abs=1e-9)


def test_index_many_and_saved_index_agree(spark, docs, tmp_path):
    rows, df = docs
    index = retrieve.capture_index(df)
    index.save(str(tmp_path), buckets=4, parts_per_bucket=2)
    saved = search.TextIndex.load(spark, str(tmp_path), buckets=4)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string")
    many = {}
    for r in search.search_many(index, queries, 100).collect():
        many.setdefault(r.query_id, {})[r.id] = r["rank"]
    for i, q in enumerate(QUERIES):
        expected = sqlite_rank(rows, q)
        for got in (many.get(i, {}), {r.id: r["rank"] for r in saved.search(q, 100).collect()}):
            assert got.keys() == expected.keys(), q
            for k in got:
                assert got[k] == pytest.approx(expected[k], abs=1e-9)


def test_index_maintenance(spark, docs):
    rows, df = docs
    gone = spark.createDataFrame([(0,), (10,)], "id long")
    fields = {c: c for c in search.CAPTURE_FIELDS}
    part = search.TextIndex.build(df.filter("id < 8"), fields).plus(search.TextIndex.build(df.filter("id >= 8"), fields))
    got = {r.id: r["rank"] for r in part.without(gone).search("the", 50).collect()}
    expected = sqlite_rank([r for r in rows if r[0] not in (0, 10)], "the")
    assert got == pytest.approx(expected, abs=1e-9)


def test_packed_numbers():
    rnd = np.random.default_rng(3)
    numbers = np.concatenate([[0, 1, 127, 128, 16383, 16384, 2**35, 2**62], rnd.integers(0, 2**40, 3000)])
    data, size = postings.gaps_to_bytes(numbers)
    back, ends = postings.bytes_to_gaps(data)
    assert (back == numbers).all() and (np.cumsum(size) - 1 == ends).all() and size[:6].tolist() == [1, 1, 1, 2, 2, 3]


def test_packed_postings_are_the_tokens(spark, docs, tmp_path):
    rows, df = docs
    fields = {c: c for c in search.CAPTURE_FIELDS}
    index = search.TextIndex.build(df, fields, False)
    plain = search.build_postings(df, fields, False)
    want = {}
    for r in plain.collect():
        want.setdefault((r.term, r.id), []).append((list(fields).index(r.field), r.pos))
    sizes = {(r.id, f.field): len(f.tokens) for r in search.token_rows(df, fields, False).collect() for f in r.f}
    got = {(r.term, r.id): (r.tf, r.places) for r in index.postings.select("term", "id", "tf", postings.positions("at").alias("places")).collect()}
    assert got.keys() == want.keys()
    names = list(fields)
    for (term, i), places in want.items():
        before = [sum(sizes[i, n] + 1 for n in names[:f]) + pos for f, pos in sorted(places)]
        assert got[term, i] == (len(places), before)
    assert {(r.id, r.len) for r in index.lengths.collect()} == {(r.id, r.len) for r in search.document_lengths(df, fields).collect()}


def weights(rows, query, gone=()):
    return sqlite_rank([r for r in rows if r[0] not in gone], query)


def test_saved_index_is_kept_up(spark, docs, tmp_path):
    """Deletes, inserts and updates of a saved index write what they bring and leave all older files as they are."""
    rows, df = docs
    path, fields = str(tmp_path / "index"), {c: c for c in search.CAPTURE_FIELDS}
    files = lambda: {str(f): f.stat().st_mtime_ns for f in pathlib.Path(path).rglob("*.parquet")}
    search.TextIndex.build(df.filter("id < 12"), fields).save(path, 4, 2, rows_per_block=2)
    first = files()
    search.TextIndex.delete(spark, path, spark.createDataFrame([(0,), (10,), (77,)], "id long"))
    with pytest.raises(ValueError):
        search.TextIndex.build(df.filter("id = 3"), fields).save(path, 4, 2, "append")
    changed = df.filter("id >= 12 OR id = 10").withColumn("fullOcrText", F.expr("if(id = 10, 'the new the text', fullOcrText)"))
    search.TextIndex.build(changed, fields).save(path, 4, 2, "append")
    assert all(files()[f] == t for f, t in first.items())
    index = search.TextIndex.load(spark, path, buckets=4)
    now = [(i, "the new the text" if i == 10 else t, *rest) for i, t, *rest in rows if i != 0]
    assert index.segments == 2 and index.gone.count() == 2
    for query in ["the", "the the", "new", "title app", "foo-bar", "connect the"]:
        want = sqlite_rank(now, query)
        assert {r.id: r["rank"] for r in index.rank(search.parse_query(query)).collect()} == pytest.approx(want, abs=1e-9), query
        top = [(r.id, r["rank"]) for r in index.search(query, 3).collect()]
        assert top == [(i, pytest.approx(r, abs=1e-9)) for i, r in sorted(want.items(), key=lambda x: (round(x[1], 9), x[0]))[:3]], query


def test_deletes_read_no_postings(spark, docs):
    """A delete joins lengths; what is read for a query afterwards leaves the deleted rows out of the query's own postings."""
    _, df = docs
    index = search.TextIndex.build(df, {c: c for c in search.CAPTURE_FIELDS})
    less = index.without(spark.createDataFrame([(3,), (4,)], "id long"))
    assert less.postings is index.postings and less.gone.count() == 2
    assert less.without(spark.createDataFrame([(4,), (5,)], "id long")).gone.count() == 3


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Three thousand rows of few words, of very different lengths, in an index of small blocks."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices(["the", "and", "of", "w%d" % rnd.randrange(40), "rare%d" % rnd.randrange(500)], [4, 3, 2, 5, 1], k=rnd.choice([3, 8, 30, 90, 200]))), None, "App")
            for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, fullOcrText string, windowTitle string, appName string")
    path = str(tmp_path_factory.mktemp("large"))
    search.TextIndex.build(df, {c: c for c in search.CAPTURE_FIELDS}, False).save(path, 4, 2, rows_per_block=16)
    return rows, path, search.TextIndex.load(spark, path, False, 4)


@pytest.mark.parametrize("query", ["the and", "the", "the the and", "of app", "w1 w2", "rare3 the", "rare3", "nothing the", "the-and of"])
def test_top_reads_some_blocks_and_ranks_all(large, query):
    _, _, index = large
    phrases, seen = search.parse_query(query, False), {}
    want = [(r.id, round(r["rank"], 9)) for r in search.best(index.rank(phrases), 20).collect()]
    assert [(r.id, round(r["rank"], 9)) for r in index.top(phrases, 20, seen).collect()] == want
    if query in ("the and", "the", "the the and"):
        assert seen["read"] < 0.5 * seen["blocks"] and seen["blocks"] > 150, seen


def test_top_after_deletes(spark, large):
    rows, _, index = large
    best = [r.id for r in index.search("the and", 30).collect()]
    less = index.without(spark.createDataFrame([(i,) for i in best[:10]], "id long"))
    want = [(r.id, round(r["rank"], 9)) for r in search.best(less.rank([["the"], ["and"]]), 20).collect()]
    assert [(r.id, round(r["rank"], 9)) for r in less.search("the and", 20).collect()] == want
    assert not {i for i, _ in want} & set(best[:10])
    expected = sqlite3_plain([r for r in rows if r[0] not in best[:10]], "the and")
    assert dict(want) == pytest.approx({i: expected[i] for i, _ in want}, abs=1e-8)


def sqlite3_plain(rows, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(a, b, c, tokenize='unicode61')")
    con.executemany("INSERT INTO f(rowid, a, b, c) VALUES (?,?,?,?)", rows)
    return dict(con.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", [match(query)]).fetchall())


def test_index_bytes(spark, large, tmp_path):
    """Packed postings against one row a token, sorted and compressed alike."""
    rows, path, _ = large
    df = spark.createDataFrame(rows, "id long, fullOcrText string, windowTitle string, appName string")
    plain = search.build_postings(df, {c: c for c in search.CAPTURE_FIELDS}, False)
    plain.repartition(8, "term").sortWithinPartitions("term", "id", "field", "pos").write.parquet(str(tmp_path / "plain"))
    size = lambda p: sum(f.stat().st_size for f in pathlib.Path(p).rglob("*.parquet"))
    assert size(f"{path}/postings") < size(tmp_path / "plain") * 1.2
    assert size(f"{path}/blocks") < size(f"{path}/postings")


def test_real_texts_with_stemming(spark):
    df = views.captures_of_documents(spark, FOLDER)
    rows = [(r.id, r.fullOcrText, r.windowTitle, r.appName) for r in df.collect()]
    index = retrieve.capture_index(df)
    for q in ["the and", "tions", "555-3824", "entering mentation", "über", "que de"]:
        expected = sqlite_rank(rows, q)
        got = {r.id: r["rank"] for r in index.rank(search.parse_query(q)).collect()}
        assert got.keys() == expected.keys(), q
        assert got == pytest.approx(expected, abs=1e-9)


def test_stems_equal_fts5_on_the_whole_vocabulary(spark):
    df = views.captures_of_documents(spark, FOLDER)
    vocabulary = [r.term for r in search.build_postings(df, {"t": "fullOcrText"}, stem=False).select("term").distinct().collect()]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(a, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab('f', 'instance')")
    con.executemany("INSERT INTO f(rowid, a) VALUES (?, ?)", enumerate(vocabulary, 1))
    theirs = {doc: term for term, doc in con.execute("SELECT term, doc FROM v WHERE offset = 0")}
    wrong = [(t, stem(t), theirs.get(i)) for i, t in enumerate(vocabulary, 1) if stem(t) != theirs.get(i)]
    assert wrong == []


def test_porter_examples():
    pairs = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "filing": "file",
             "happy": "happi", "sky": "sky", "adjustable": "adjust", "controlling": "control", "rate": "rate"}
    assert {w: porter(w) for w in pairs} == pairs


def summaries(spark):
    rows = [(i, at(60 * i), at(60 * i + 30), [a], f"alpha {'beta ' * i}", ["t"], [i]) for i, a in
            enumerate(["Safari", "Mail_X", "MailAX", "Notes", "Safari Tech"])]
    return spark.createDataFrame(rows, "id long, startTs timestamp, endTs timestamp, appNames array<string>, summary string, "
                                       "keyTopics array<string>, captureIds array<long>")


def test_summary_filters_before_limit(spark):
    s = summaries(spark)
    ids = lambda **k: [r.id for r in search.search_summaries(s, "alpha", **k).collect()]
    assert ids() == [0, 1, 2, 3, 4]
    assert ids(app="SAFARI", limit=2) == [0, 4]
    assert ids(app="mail_x") == [1, 2]          # _ is a wildcard
    assert ids(app="M%X") == [1, 2]
    assert ids(now=at(60 * 4 + 30), minutes=1) == [3, 4]
    ranks = {r.id: r["rank"] for r in search.search_summaries(s, "alpha").collect()}
    assert {r.id: r["rank"] for r in search.search_summaries(s, "alpha", app="notes").collect()} == {3: ranks[3]}


def test_api_rules(spark):
    s = summaries(spark)
    with pytest.raises(api.InvalidRequest):
        api.search(s, "  \n", at(0))
    with pytest.raises(api.InvalidRequest):
        api.search(s, "x", at(0), limit=-1)
    with pytest.raises(api.InvalidRequest):
        api.activity(s, s, at(0), kind="other")
    hit = api.search(s, " beta ", at(300), app="notes").first()
    assert hit.relevance_explanation == "FTS match — topics: t" and hit.window_title is None
    assert hit.timestamp == "2024-01-01T00:03:00Z"
    assert api.list_summaries(s, at(100), minutes=-5, limit=0).count() == 1
    assert search.sanitize_query(' a "b"  ""\tc ') == ["a", "b", "", "c"]
    assert api.search_metadata(api.search(s, "beta", at(300)), "beta").first().summaries_searched == 4


ODD = ["İstanbul IŞIK", "Ⱥx ⱥy ȺZ", "ß ²½ª ǅ x²y", None, "", " \t\n", "áb café ́x", "日本 語x 1２3", "ef g", "😀a b😀", "ɀa ɐb", "ÀÉ-Ÿ_ñ'o",
       " x­z×w÷v", "x" * 300 + "ÿ", "one", "a" + "ͅ" + "A"]


def test_texts_are_cut_as_the_expression_cuts_them(spark):
    """Packing cuts texts of low code points itself; every code point below the bound, alone and between letters, and texts beyond it."""
    texts = ODD + [f"q{chr(i)}r {chr(i)}" for i in range(0x300)]
    df = spark.createDataFrame([(i, t, texts[-i - 1]) for i, t in enumerate(texts)], "id long, a string, b string").repartition(5)
    for stem_ in (False, True):
        index = search.TextIndex.build(df, {"a": "a", "b": "b"}, stem_, keep=False)
        tokens = df.select("id", search.tokenize("a", stem_).alias("a"), search.tokenize("b", stem_).alias("b")).collect()
        want = {}
        for r in tokens:
            for place, t in [*enumerate(r.a), *enumerate(r.b, len(r.a) + 1)]:
                want.setdefault((r.id, t), []).append(place)
        got = {(r.id, r.term): r.at for r in index.postings.select("id", "term", postings.positions("at").alias("at")).collect()}
        assert got == want
        assert {(r.id, r.len) for r in index.lengths.collect()} == {(r.id, len(r.a) + len(r.b)) for r in tokens}


def test_writers_of_an_index_grow_with_it(spark, large, tmp_path, monkeypatch):
    """What one writer sorts is bounded, whatever the number of buckets; blocks stay in one file and no intermediate of all postings is stored."""
    rows, _, index = large
    df = spark.createDataFrame(rows, "id long, fullOcrText string, windowTitle string, appName string")
    monkeypatch.setattr(search, "TOKENS_PER_WRITER", 2000, raising=False)
    path = str(tmp_path / "index")
    search.TextIndex.build(df, {c: c for c in search.CAPTURE_FIELDS}, False, keep=False).save(path, 4, 2, rows_per_block=16)
    files = list(pathlib.Path(f"{path}/postings").rglob("*.parquet"))
    tokens = index.totals.first().tokens
    assert tokens > 100_000 and len(files) > tokens // 2000 // 2
    assert max(spark.read.parquet(str(f)).count() for f in files) < 4000
    again = search.TextIndex.load(spark, path, False, 4)
    homes = spark.read.parquet(f"{path}/postings").select("term", "block", F.input_file_name().alias("f")).groupBy("term", "block").agg(F.countDistinct("f").alias("n"))
    assert homes.filter("n > 1").isEmpty()
    for query in ["the and", "w1 w2", "rare3 the", "the-and of"]:
        phrases = search.parse_query(query, False)
        assert [(r.id, round(r["rank"], 9)) for r in again.top(phrases, 20).collect()] == [(r.id, round(r["rank"], 9)) for r in index.top(phrases, 20).collect()]


def test_dealt_postings_come_sorted(spark):
    rows = [(i // 2, " ".join(f"w{(i * k) % 23}" for k in range(1 + i % 40)) + (" 日本 ẞ" if i % 5 == 0 else ""), None if i % 3 else "Déjà w1") for i in range(300)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "id long, a string, b string").coalesce(1)
    packed = postings.pack(df, "id", ["a", "b"]).collect()
    # Lengths are counted without packing, in the same order.
    counted = postings.pack(df, "id", ["a", "b"], places=False).select("id", "len").collect()
    assert counted == [(r.id, r.len) for r in packed if r.term is None]
    levels = [(5, 2), (20, 3), (60, 1)]
    got = postings.pack_dealt(df, "id", ["a", "b"], None, levels, 3).withColumn("hash", F.xxhash64("id")).collect()
    plain = lambda rs: sorted((-1 if r.id is None else r.id, r.len, r.term, r.tf, bytes(r.at)) for r in rs)
    assert plain(got) == plain(r for r in packed if r.term is not None)
    place = [next((i, r.hash % n) for i, (most, n) in enumerate(levels) if r.len <= most) for r in got]
    order = [(r.writer, r.term.encode(), p) for r, p in zip(got, place)]
    assert order == sorted(order) and {r.writer for r in got} == {0, 1, 2}
    assert len({(p, r.writer) for r, p in zip(got, place)}) == len(set(place))


def test_build_for_saving_equals_the_stored_one(spark, large, tmp_path):
    docs = spark.createDataFrame(large[0], "id long, fullOcrText string, windowTitle string, appName string")
    fields = {c: c for c in search.CAPTURE_FIELDS}
    for name, keep in (("a", False), ("b", True)):
        index = search.TextIndex.build(docs, fields, True, keep=keep)
        assert (index.texts is None) == keep
        index.save(f"{tmp_path}/{name}", 4, 3, rows_per_block=16)
        assert index.without(docs.limit(1).select("id")).texts is None
    a, b = (search.TextIndex.load(spark, f"{tmp_path}/{name}", True, 4) for name in "ab")
    for x, y in ((a.postings, b.postings), (a.lengths, b.lengths), (a.totals, b.totals)):
        assert x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
    assert a.gone is None and a.lengths.schema == b.lengths.schema


def test_a_saved_index_is_lists(spark, large, tmp_path):
    """Writers get texts, not postings, and write many postings in a row; read back they are those that are packed, and blocks stay in one file."""
    fields = {c: c for c in search.CAPTURE_FIELDS}
    docs = spark.createDataFrame([*large[0], (7, "the déjà 日本 the", None, "App"), (None, "the w1 of", "the", "App"), (3000, None, None, None)],
                                 "id long, fullOcrText string, windowTitle string, appName string")
    index = search.TextIndex.build(docs, fields, False, keep=False)
    index.save(f"{tmp_path}/i", 4, 2, rows_per_block=16)
    files = spark.read.parquet(f"{tmp_path}/i/postings").withColumn("f", F.input_file_name())
    again = search.TextIndex.load(spark, f"{tmp_path}/i", False, 4)
    columns = ["id", "len", "term", "tf", "at"]
    want = index.postings.select(*columns)
    n = want.count()
    assert files.count() < 0.5 * n and files.filter((F.col("n") != F.size("id")) | (F.col("n") > postings.LIST)).isEmpty() and again.postings.count() == n
    assert again.postings.select(*columns).exceptAll(want).isEmpty() and want.exceptAll(again.postings.select(*columns)).isEmpty()
    assert files.select("term", F.explode(postings.positions("block")).alias("block"), "f").groupBy("term", "block").agg(F.countDistinct("f").alias("n")).filter("n > 1").isEmpty()
    # Blocks of lists are those of single rows.
    key = ["term", "block", "tf"]
    added = lambda rows: rows.groupBy(*key).agg(F.sum("rows").alias("rows"), F.min("len").alias("len"))
    frequent = again.postings.groupBy("term").count().filter(F.col("count") >= search.FREQUENT).select("term")
    blocks, single = added(again.blocks), added(postings.tops(again.postings.select(*key, "len").join(frequent, "term", "left_semi")))
    assert blocks.exceptAll(single).isEmpty() and single.exceptAll(blocks).isEmpty() and blocks.count() > 100
    # Places of a row are not read where only counts are asked for.
    assert "at:" not in again.postings.groupBy("term").agg(F.sum("tf"))._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
