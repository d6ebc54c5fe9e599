"""Operators that look at one text at a time, against plain loops and the libraries."""
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronoscribe.llm import quality, sentence, tokens

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def judged(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit |= {i, i + 1, i + 2}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit),
            len(words) < 50 or 100 * len(hit) > 50 * len(words))


def test_quality_measures(docs, texts):
    rows = quality.ledger(docs).select("doc_id", "ledger.*").withColumn("bad", quality.failed(F.col("failures"), "base-1")).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.bad) for r in rows}
    assert got == {i: judged(t) for i, t in texts}


def test_quality_policies_and_ablation(docs, none):
    rows = quality.ledger(docs).select("doc_id", "ledger.*").cache()
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert kept.count() == rows.filter("failures = 0").count() > 0
    table = {r.rule: r for r in quality.ablation(rows).collect()}
    for i, rule in enumerate(quality.RULES):
        bits = [r.failures for r in rows.collect()]
        assert table[rule.name].n_failed == sum(b >> i & 1 for b in bits)
        assert table[rule.name].n_failed_only == sum(b == 1 << i for b in bits)
        together = 0
        for b in bits:
            together |= (b & ~(1 << i)) if b >> i & 1 else 0
        assert table[rule.name].fails_with == together
    assert quality.keep(none).count() == 0 and quality.ablation(quality.ledger(none).select("ledger.*")).first().n_failed == 0


def test_sentence_is_the_library(docs, texts, none):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = sentence.decode(sentence.encode(docs, PIECES, ids="pieces", check="texts"), PIECES, "pieces")
    assert out.columns == [*docs.columns, "pieces", "decoded"]
    for r in out.collect():
        want = lib.encode(r.text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.pieces, "<u4").tolist() == want
        assert r.decoded == lib.decode(want)
    assert sentence.encode(none, PIECES, ids="pieces").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_agenda_on_random_words(seed):
    rng = np.random.default_rng(seed)
    voc = sentence.Vocabulary(PIECES)
    letters = list("etaoin shrdlu\nxéß0.▁日")
    texts = ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(300)]
    sentence.encode_texts(voc, texts, "texts")
    for t in texts[:50]:  # one at a time, by the heap
        word = t.replace(" ", "").replace("\n", "").replace("▁", "")
        assert voc.merge(word) == voc.library.encode("\n" + word)[2:]


def test_token_files(spark, docs, texts, none):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(BYTES)
    manifest = tokens.write(docs.union(docs.limit(0)).withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id"))), BYTES)
    rows = tokens.read(manifest).orderBy("start").collect()
    order = sorted(texts, key=lambda r: (r[0] != 7, r[0]))  # a null id comes first
    start = 0
    for r, (i, t) in zip(rows, order, strict=True):
        want = lib.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens) == (None if i == 7 else i, start, len(want))
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        start += len(want)
    assert tokens.read(tokens.write(none, BYTES)).count() == 0


def test_registered_digests(spark):
    from chronoscribe.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    import sentencepiece
    from tokenizers import Tokenizer
    lib, bpe = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES)
    for r in QUERIES["op2_sentencepiece"](spark, folder).collect():
        ids = lib.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    for r in QUERIES["op5_token_files"](spark, folder).collect():
        ids = bpe.encode(text[r.doc_id], add_special_tokens=False).ids + [0]
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_chunks_are_the_library():
    """Chunks and their parts against the library, on texts made of what tokens begin and end with."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer
    lib, enc, rng = Tokenizer.from_file(BYTES), tokens.Encoder(BYTES, 0), random.Random(1)
    some = [" ", " ", "\n", ".", ",", "a", "B", "é", "1", "'s", "'", "_", "日", "(", "\t", "\n\n", "  ", "the", "x.", "\xa0", "’", "²", "<|endoftext|>", "\x1c"]
    texts = ["".join(rng.choice(some[:-2] if rng.random() < .9 else some) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    for at in range(0, len(texts), 500):
        part = texts[at:at + 500]
        for t, ids in zip(part, enc.encode(pa.array(part))):
            assert np.frombuffer(ids, enc.width).tolist() == lib.encode(t, add_special_tokens=False).ids + [0], repr(t)


def test_new_chunks_of_token_files_share_calls():
    """New words go to the library many in one text, stops and line breaks are cut off first; ids stay those of whole texts."""
    import pyarrow as pa
    from tokenizers import Tokenizer
    enc, lib, sent = tokens.Encoder(BYTES, 0), Tokenizer.from_file(BYTES), []
    ids = enc._ids
    enc._ids = lambda texts: sent.extend(texts) or ids(texts)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é{i}" for i in range(600)]
    odd = ["", " ", "\n", "a\nb", "\na", "a\n", "a\n\nb c", "1,234.5 it's. x", "a.\nb ,c .d", "é.é ,é\ne", "a \n b", "x y \u0085z", "q\x1c r\x1c\x1cs",
           "a<|endoftext|>. b", "a.b,c\n.d\n,e", " . , \n", "a\r\nb.\tc", "中.文,\n字 。x"]
    texts = ["".join(f" {w}{'.,'[i % 2]}" + "\n" * (i % 7 == 0) + f"v{i % 3}" for i, w in enumerate(words)), *odd, "\n".join(words)]
    got = [np.frombuffer(b, enc.width).tolist() for b in enc.encode(pa.array(texts))]
    assert got == [[*lib.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert len(sent) < 1000
    assert enc.encode(pa.array(texts)) == [np.array(g, enc.width).tobytes() for g in got]
