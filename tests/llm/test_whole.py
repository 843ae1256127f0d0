"""Operators that give a row per document or piece, and the pipeline."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from folioforge.llm import bpe, imatch, langid, packing, queries, sharding, tokens

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
ODD = [(1, "Some text. More of it!"), (2, None), (3, ""), (3, ""), (None, "a<|endoftext|>b"), (5, "x" * 3000), (6, "word " * 2000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("frequent", [tokens.FREQUENT, 40, 0])
def test_token_counts(spark, docs, frequent):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + ODD
    got = tokens.token_counts(spark.createDataFrame(rows, DOC), P.path("byte_bpe_50k.json"), frequent=frequent).collect()
    want = sorted((str(i), len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_each_distinct_pre_token_is_counted_once(spark):
    rows = [(1, "a word, a word"), (2, " word a"), (3, None), (4, "a<|endoftext|>b")]
    got = {r.piece: (r.frequency, r.tokens) for r in tokens.pre_token_table(spark.createDataFrame(rows, DOC), P.path("byte_bpe_50k.json")).collect()}
    assert got == {"a": (2, 1), " word": (3, 1), ",": (1, 1), " a": (2, 1), "b": (1, 1)}


def test_files_that_split_otherwise_are_refused():
    with pytest.raises(ValueError):
        tokens.LibraryPieces(P.path("word_bpe_49k.json"), False, 10)


def test_bpe_digests(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.encode_decode(spark.createDataFrame(ODD, DOC), path, with_ids=True).collect()
    assert len(got) == len(ODD)
    for (i, t), r in zip(ODD, got):
        ids = bpe.vocabulary(path).encode(t or "")
        assert (r.doc_id, r.n_tokens, r.ids) == (i, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_packing_round_trips(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000, None), (10_001, ""), (10_002, "x" * 30_000)]
    frame = spark.createDataFrame(rows, DOC).repartition(3)
    pieces = packing.pack(frame, P.path("byte_bpe_50k.json")).collect()
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(spark.createDataFrame([], DOC), P.path("byte_bpe_50k.json")).count() == 0


def test_cuts_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(40):
        position = np.append(0, np.cumsum(rng.integers(1, 9, 12)))
        penalty = rng.integers(0, 4, 13).astype(float)
        best = {0: 0.0}
        for j in range(1, 13):
            best[j] = min(best[i] + 10 - (position[j] - position[i]) + penalty[j] for i in range(j) if position[j] - position[i] <= 10)
        cut = packing.choose_cuts(position, penalty, 10)
        assert cut[0] == 0 and cut[-1] == 12
        assert sum(10 - np.diff(position[cut])) + penalty[cut[1:]].sum() == pytest.approx(best[12])


def test_sharding(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(900 + k, "the very same text " * 60) for k in range(150)] + [(None, None), (None, "")]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOC).repartition(3), 8).collect()
    assert len(got) == len(rows)
    total, slots = [0] * 8, [[] for _ in range(8)]
    for r in got:
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    most = max(r.size for r in got)
    assert max(total) - min(total) <= 2 * most + 0.08 * sum(total) / 8
    by_text = {r.doc_id: r for r in got}
    for i, t in rows:
        if i is not None:
            assert by_text[i].size == len((t or "").encode()) + 16 and by_text[i].text_crc32 == zlib.crc32((t or "").encode())
    assert sharding.shard_documents(spark.createDataFrame([], DOC), 8).count() == 0


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = langid.held_out_rule(F.col("doc_id"))
    model = langid.train(docs, held_out)
    told = langid.identify(docs.where(held_out), model)
    assert told.where("lang = lang_pred").count() >= 0.97 * told.count()
    odd = langid.identify(spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "123 ... !", "q")], "doc_id long, text string, Score string"), model)
    assert [(r.lang_pred, r.score, r.ambiguous) for r in odd.collect()] == [("und", 0.0, True)] * 3
    nothing = langid.train(docs.withColumn("lang", F.lit(None).cast("string")), held_out)
    assert langid.identify(docs, nothing).where("lang_pred != 'und'").count() == 0
    assert langid.keep_identified(docs, nothing).count() == docs.count()


@pytest.mark.parametrize("n", [2, 3, 5, 6, 9, 40])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n and (np.abs(code.sum(axis=0)) < n).all()


def test_fingerprints_and_edits(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(5000, None), (5001, ""), (5002, "one"), (None, "two words")]
    frame = spark.createDataFrame(rows, DOC).repartition(3)
    words = imatch.lexicon(frame)
    got = {r.doc_id: r for r in imatch.fingerprints_with_edits(frame, words).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (i, t), (j, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_next == pytest.approx(imatch.likeness(r.fingerprint, got[j].fingerprint))
        assert r.near_edited == pytest.approx(imatch.likeness(r.fingerprint, r.edited_fingerprint))
    same = {}
    for i, t in rows:
        assert same.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint
    assert np.mean([r.near_edited for r in got.values()]) > 5 * np.mean([r.near_next for r in got.values()])
    assert imatch.fingerprints_with_edits(spark.createDataFrame([], DOC), words).count() == 0
    one = imatch.fingerprints_with_edits(spark.createDataFrame([(1, "a b c d")], DOC), words).first()
    assert one.near_next == 1.0


def test_document_frequency_is_exact(spark):
    frame = spark.createDataFrame([(1, "a b a"), (2, "B c"), (3, None)], DOC)
    assert sorted(r.df for r in imatch.document_frequency(frame).collect()) == [1, 1, 2]


def test_pipeline_stage_by_stage(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "suffix-array dedup", "packing"]
    rows, frame = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns
        assert 0 < frame.count() <= rows
        rows = frame.count()
    assert frame.where("n_chars != length(text)").count() == 0
    kept = {r.doc_id for r in frame.collect()}
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
