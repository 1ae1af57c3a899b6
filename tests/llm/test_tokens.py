"""Tokens, vectors, language model and pipeline against brute force or the libraries themselves."""

import hashlib
import math
import os
import random
import zlib
from base64 import b64decode
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strandwise.llm import bpe, language_model, pivots, queries, token_files, tokens

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "a  b", "a   b", " x\n\n y\t z ", "don't 's   ", "<|endoftext|> a", "　x  ", "a.b,c!! é.É, x٣٣ ñ's",
    "\x1c a \x85 b", "ª² x½ ı.", "\n", "x \x00 y z", "😀 👍🏽 é", "a  b", "wort" * 300, "ü" * 70, "12345 67,8.9", "ab " * 2000,
]


@pytest.fixture
def docs(spark):
    rows = [(i * 3, t, "x") for i, t in enumerate(ODD)]
    rows += [(3, ODD[3], "x"), (None, "null id", "x"), (3, "same id", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, start string")


def scan(spark, df, tmp_path):
    df.write.mode("overwrite").parquet(str(tmp_path / "scan"))
    return spark.read.parquet(str(tmp_path / "scan"))


def ids_of(text):
    t = Tokenizer.from_file(queries.BPE_50K)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoder():
    encode = tokens.encoder(queries.BPE_50K).encode
    for _ in range(2):  # the second time from the kept segments
        for t in ODD[1:]:
            assert np.frombuffer(encode(t), "<u4").tolist() == ids_of(t)
            assert "".join(tokens.segments(t)) == t


def test_token_files(spark, docs, no_docs, tmp_path):
    folder = str(tmp_path / "tokens")
    files = token_files.write_token_files(docs, queries.BPE_50K, folder, length=64, batch=4)
    rows = token_files.read_documents(spark, files, docs, folder).collect()
    order = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for k, t in order:
        ids = np.array([*ids_of(t), 2], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    whole = []
    for f in files:
        file = token_files.TokenFile(f["sequences"])
        for i in range(-(-f["n_tokens"] // 64)):
            ids, mask = file.sequence(i)
            assert not ids.flags.owndata and len(ids) == 64 and ids.dtype == np.uint16
            whole += ids[np.unpackbits(mask, bitorder="little").astype(bool)].tolist()
    assert whole == [x for _, t in order for x in (*ids_of(t), 2)]
    assert token_files.write_token_files(no_docs, queries.BPE_50K, folder) == []
    assert token_files.read_documents(spark, [], no_docs, folder).count() == 0


def test_bpe(docs, no_docs):
    with open(queries.BPE_MULTI, "rb") as f:
        ranks = {b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_and_decode(docs, queries.BPE_MULTI, public_tokenizers.PATTERN).collect()
    want = Counter()
    for r in docs.collect():
        ids = own.encode_ordinary(r.text or "")
        joined = ",".join(map(str, ids)).encode()
        want[(r.doc_id, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want
    assert bpe.encode_and_decode(no_docs, queries.BPE_MULTI, public_tokenizers.PATTERN).count() == 0
    lists = bpe.token_lists(docs.where("doc_id = 12"), queries.BPE_MULTI, public_tokenizers.PATTERN).collect()
    assert lists[0].ids == own.encode_ordinary(ODD[4])


def test_long_words_by_heap():
    own = bpe.codec(queries.BPE_MULTI, public_tokenizers.PATTERN)
    rng = random.Random(1)
    made = ["".join(rng.choices("abcdeth", k=rng.randint(3, 40))) for _ in range(300)]
    made += ["".join(rng.choices("abcdeth", k=k)) for k in (65, 200, 200, 500, bpe.LONG_WORD)] + ["語" * 40, "天地玄黄宇宙洪荒" * 9, "a" * 300]
    by_query = own.encode_words(made)
    for w in made:
        if w.encode() not in own.ranks:
            assert by_query[w] == ",".join(map(str, bpe.heap_merge(w.encode(), own.ranks)))


def test_few_rows_a_query(monkeypatch):
    """Words dealt out over many queries have the ids of one query; a word beyond the bound goes alone."""
    own = bpe.codec(queries.BPE_MULTI, public_tokenizers.PATTERN)
    made = [f"xq{i}zz" * (1 + i % 5) for i in range(60)]
    want = own.encode_words(made)
    monkeypatch.setattr(bpe, "ROWS_A_QUERY", 90)
    assert own.encode_words(made) == want and len(want) == 60


@pytest.mark.parametrize("block", [65536, 40])
def test_top_k(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(1).tolist(), 1) for i in range(300)]
    rows += [(400, None, 1), (401, [1.0, None], 1), (402, [float("nan")] * 8, 1), (403, [float("inf")] * 8, 1)]
    rows += [(500, [], 1), (450, [0.5] * 3, 1), (50, rows[50][1], 1), (None, rows[7][1], 1), (600, [40.0] * 8, 1)]
    table = scan(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int"), tmp_path)
    got = pivots.top_k(table, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect()
    good = [(k, [math.floor(256 * x) for x in v]) for k, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    wide = [(k, v + [0] * (8 - len(v))) for k, v in good]
    want = Counter()
    for i, (k, q) in enumerate(wide):
        if k is None or k % 50:
            continue
        scores = [(-sum(a * b for a, b in zip(q, v)), o is None, o or 0, o) for j, (o, v) in enumerate(wide) if j != i]
        for rank, (s, _, _, o) in enumerate(sorted(scores)[:5], 1):
            want[(k, rank, o, -s)] += 1
    assert Counter(map(tuple, got)) == want
    assert pivots.top_k(table.limit(0), "vec_id", "embedding", F.col("vec_id") % 50 == 0).count() == 0


def test_language_model(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)]
    rows = []
    for i in range(400):
        at, text = rng.randrange(60), []
        for _ in range(rng.randint(5, 60)):  # each word has few followers
            text.append(vocabulary[at])
            at = (at * 7 + rng.choice([1, 1, 1, 2])) % 60
        rows.append((i, " ".join(text).upper() if i % 9 == 0 else " ".join(text), "x"))
    rows += [(900, None, "x"), (901, "", "x"), (902, "unseen words here", "x"), (None, "abcd", "x"), (5, rows[5][1], "x")]
    rows.append((903, "abcd efgh " * 9000, "x"))
    table = scan(spark, spark.createDataFrame(rows, "doc_id long, text string, row string"), tmp_path)
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    got = language_model.fit_and_score(table, train).collect()
    toks = [(k, [w.lower() for w in (t or "").split()] + [None]) for k, t, _ in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in toks]
    count = Counter(w for (_, ws), h in zip(toks, held) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    want = Counter()
    for (k, ws), h in zip(toks, held):
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)
        want[(k, not h, len(ws), sum(count[w] > 0 for w in ws), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if not r.train and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.score for r in out) > 0.75 * sum(r.base_score for r in out)  # both are negative
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    empty = language_model.fit_and_score(table, F.lit(False)).agg(F.min("score"), F.min("base_score")).first()
    assert tuple(empty) == (0.0, 0.0)
    assert language_model.fit_and_score(scan(spark, table.limit(0), tmp_path / "none"), train).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept, folder = docs, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stages"
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, kept, SF)
        assert out.schema.names == docs.schema.names
        out.write.mode("overwrite").parquet(f"{folder}/{k}")
        kept = spark.read.parquet(f"{folder}/{k}")
        if k == 1:
            left = {r.doc_id for r in kept.select("doc_id").collect()}
            wrong = [d for d, r in labels.items() if r.quality == 0 and d in left]
            assert not wrong
    assert 0 < kept.count() < docs.count()
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.select("doc_id").collect()}
    assert [len({r.sequence_id for r in packed})] == [max(r.sequence_id for r in packed) + 1]
    assert len(corpus_pipeline.STAGES) == 5
