"""Queries over whole texts see what stands far into a text."""

import duckdb

from folioforge.plans import registry


def documents(spark, tmp_path, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'src' as source", "cast(length(text) as long) as n_chars")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_detectors_read_past_the_prefix(spark, tmp_path):
    sf = documents(spark, tmp_path, [(34, "calm " * 60 + "drop table x"), (69, "calm " * 60 + "; rm -rf / and on"), (104, "calm " * 60)])
    run = lambda name: {r[0]: tuple(r[1:]) for r in registry.QUERIES[name](spark, sf).collect()}
    assert run("g8_j8_safety") == {34: ("destructive", "require_human"), 69: ("destructive", "require_human"), 104: (None, None)}
    assert run("g7_route") == {34: ("require_human",), 69: ("require_human",), 104: ("allow",)}
    assert run("g34_injection") == {34: (None,), 69: ("command",), 104: (None,)}


def test_direct_hit_stands_with_all_scored_rows(spark, tmp_path):
    sf = documents(spark, tmp_path, [(k, "the license") for k in range(1, 21)])
    got = {r.id: r.score for r in registry.QUERIES["g3_direct_hit"](spark, sf).collect()}
    assert set(got) == set(range(1, 21)) and got[7] == 1.0 and all(0 < got[k] < 1 for k in got if k != 7)


def test_books_and_pages_hold_all_of_a_text(spark, tmp_path):
    text = "\n".join(f"line {k} of a long text" for k in range(200))
    sf = documents(spark, tmp_path, [(1, text)])
    run = lambda name: registry.QUERIES[name](spark, sf).collect()
    assert {r.line for r in run("s1_lines")} >= set(text.split("\n"))
    assert {x for r in run("s7_w1_w2_chapters") for x in r.body_lines} >= set(text.split("\n"))
    assert any("line 199 of a long text" in r.html for r in run("w8_paragraphs"))
    assert {r.page for r in run("a30_line_tolerance")} == set(range(30))


def test_heads_of_missing_and_empty_texts_equal_their_sql(spark, tmp_path):
    texts = [None, "", " ", "a", "\u0000e\u0301" * 70, "x" * 199, "x" * 200, "漢" * 201, "x" * 320, "x" * 8000, "漢" * 40000]
    sf = documents(spark, tmp_path, list(enumerate(texts)))
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{sf}/documents.parquet/*.parquet'")
    want = {r[0]: repr(r[1:]) for r in duck.sql(registry.ORACLE["g44_head_summary"]).fetchall()}
    got = {r.doc_id: repr((r.head, r.ratio)) for r in registry.QUERIES["g44_head_summary"](spark, sf).collect()}
    assert len(got) == len(texts) and got == want
    assert got[0] == "(None, None)" and got[1] == "('', nan)"
