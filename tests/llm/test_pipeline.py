"""Every stage of the pipeline, and all of them, against plain versions."""
import numpy as np
import public_tokenizers

import corpus_pipeline
from chronoscribe.llm import quality, secret
from test_llm_plain import decontaminated, judged_kept, jaccard_components, redacted

FOLDER = "/root/testdata/sf0.001"


def plain(rows, items):
    """(id, text) after the four filtering stages."""
    rows = [r for r in rows if judged_kept(r[1])]
    ids = jaccard_components(rows)
    rows = [r for r in rows if ids[r[0]] == r[0]]
    rows = [r for r in rows if decontaminated(r[1], items)]
    return [(i, redacted(t, secret.RULES)) for i, t in rows]


def test_run(spark):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = dict(plain([(r.doc_id, r.text) for r in docs.collect()], items))
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == [*docs.columns, "ids"]
    rows = out.collect()
    assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want) > 0
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == lib.encode(r.text, add_bos=True, add_eos=True)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (5, "word " * 60_000, None, "s", 1)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for some in (odd, odd.limit(0)):
            out = stage(spark, some, FOLDER)
            assert out.columns == docs.columns and out.count() <= some.count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd, FOLDER).count() == 4


def test_near_copies_of_five_words(spark):
    """One edit in 49 words leaves 0.80 of the 5-word shingles and 0.84 of the 4-word ones: one copy stays. In 48 words both do."""
    def pair(n, edits, at):
        words = [f"w{at}x{i}" for i in range(n)]
        other = [f"e{at}" if i in edits else w for i, w in enumerate(words)]
        return " ".join(words), " ".join(other)

    rows, kept = [], []
    for at, (n, edits) in enumerate([(54, {20}), (100, {20, 60}), (48, {20}), (49, {20}), (60, {20, 40}), (400, {20, 60, 100, 140, 180, 220, 260, 300})]):
        two = pair(n, edits, at)
        sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in two)]
        near = 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])
        rows += [(2 * at, two[0], "en", "s", 1), (2 * at + 1, two[1], "en", "s", 1)]
        kept += [2 * at] if near else [2 * at, 2 * at + 1]
    df = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, df.schema), FOLDER)
    assert sorted(r.doc_id for r in got.collect()) == kept


def test_policies_name_rules():
    names = {r.name for r in quality.RULES}
    assert all(set(p) <= names for p in quality.POLICIES.values())
