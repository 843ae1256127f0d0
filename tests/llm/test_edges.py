"""Every registered query on its table, and every operator on odd rows, odd columns and empty tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from folioforge.llm import bpe, embeddings, imatch, langid, linededup, minhash, packing, queries, sharding, suffixdedup, tokens
from folioforge.llm.textnum import word_hashes

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op2_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op3_line_dedup": "doc_id n_lines n_removed kept_sha256",
    "op4_near_duplicates": "doc_id class_id kept",
    "op5_language_id": "doc_id held_out lang_pred score",
    "op6_embedding_links": "vec_id n_links component_id kept",
    "op7_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op8_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_each_query_gives_its_columns_for_every_row(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    key = out.columns[0]
    got = [r[0] for r in out.select(key).collect()]
    want = [r[0] for r in spark.read.parquet(f"{SF}/{'embeddings' if key == 'vec_id' else 'documents'}.parquet").select(key).collect()]
    assert sorted(set(got) if name == "op9_packing" else got) == sorted(want)


LONG = "word " * 300_000
ROWS = [(1, "Some text. More of it!", "en"), (2, None, None), (3, "", "de"), (3, "", "de"), (None, "no id", "en"), (None, "no id", "en"), (5, "x" * 3000, None), (6, LONG, "en"), (7, LONG, "en"), (1, "other text of one id", "en")]
OTHERS = ("id", "tie", "key", "part", "row", "rest", "known", "node", "profile", "piece", "number", "gone", "spans", "H", "kind", "shard", "_key", "N_Tokens", "Score", "held_out", "Kept", "class_id", "lang_pred")


def odd(spark, rows=ROWS):
    frame = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    return frame.withColumns({c: F.lit(c) for c in OTHERS})


def operators():
    tok, ranks = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
    return {
        "op1": lambda d: suffixdedup.dedup_substrings(d),
        "op2": lambda d: sharding.shard_documents(d, 3),
        "op3": lambda d: linededup.dedup_lines(d),
        "op4": lambda d: minhash.near_duplicates(d),
        "op4 rows": lambda d: minhash.drop_near_duplicates(d),
        "op5": lambda d: langid.identify(d, langid.train(d, langid.held_out_rule(F.col("doc_id")))),
        "op7": lambda d: tokens.token_counts(d, tok),
        "op8": lambda d: imatch.fingerprints_with_edits(d, imatch.lexicon(d)),
        "op8 rows": lambda d: imatch.fingerprints(d, imatch.lexicon(d)),
        "op9": lambda d: packing.pack(d, tok),
        "op10": lambda d: bpe.encode_decode(d, ranks),
    }


@pytest.mark.parametrize("name", operators())
def test_odd_rows_and_columns(spark, name):
    frame = odd(spark)
    out = operators()[name](frame)
    ids = sorted(str(r.doc_id) for r in out.select("doc_id").collect())
    want = sorted(str(r[0]) for r in ROWS)
    if name == "op4 rows":
        assert ids == sorted(["1", "1", "2", "5", "6", "None"])  # texts 3, 3 are that of 2, and 7 is 6
    else:
        assert (set(ids) == set(want)) if name == "op9" else ids == want
    assert dict(out.dtypes)["doc_id"] == "int"
    if name in ("op1", "op3", "op4 rows", "op5", "op8 rows"):  # the other columns go through
        replaced = {"op5": {"score", "lang_pred"}}.get(name, set())
        for c in OTHERS:
            if c.lower() not in replaced:
                assert {r[0] for r in out.select(f"`{c}`").collect()} == {c}


@pytest.mark.parametrize("name", operators())
def test_empty_tables(spark, name):
    assert operators()[name](odd(spark).where("doc_id > 99")).count() == 0


def test_embeddings_of_int_ids_odd_columns_and_strings(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1), (None, [1.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int").withColumns({c: F.lit(c) for c in OTHERS})
    out = embeddings.link_embeddings(frame)
    assert dict(out.dtypes)["vec_id"] == "int" and dict(out.dtypes)["component_id"] == "int"
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out.collect()) == [("1", 2, "1"), ("2", 2, "1"), ("2", 2, "1"), ("3", 0, "3"), ("None", 0, "None")]
    with pytest.raises(TypeError):
        embeddings.link_embeddings(frame.withColumn("vec_id", F.lit("a")))
    with pytest.raises(TypeError):
        imatch.fingerprints_with_edits(odd(spark).withColumn("doc_id", F.lit("a")), np.zeros(0, np.uint64))


def test_fingerprints_equal_plain_i_match(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    terms = [{int(h) for h in word_hashes([t])[0]} for _, t in rows]
    df = {}
    for own in terms:
        for h in own:
            df[h] = df.get(h, 0) + 1
    low, high = max(2.0, imatch.BAND[0] * len(rows)), imatch.BAND[1] * len(rows)
    inside = {h for h, n in df.items() if low <= n <= high}
    assert sorted(inside) == imatch.lexicon(docs).tolist()
    mix = lambda h, k: int(imatch.splitmix(np.array([h], np.uint64) ^ imatch._SEEDS[k])[0])
    got = {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs, imatch.lexicon(docs)).collect()}
    for (i, _), own in list(zip(rows, terms))[:40]:
        kept = sorted(own & inside) or sorted(own)
        for k in range(0, imatch.SUBSETS, 9):
            chosen = [h for h in kept if mix(h, k) < int(imatch._KEEP[k])]
            want = hashlib.blake2b(np.array(chosen, np.uint64).tobytes(), digest_size=3).hexdigest() if chosen else imatch.EMPTY
            if kept:
                assert got[i][k * 6 : k * 6 + 6] == want
