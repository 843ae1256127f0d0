"""The corpus pipeline against a brute-force version, stage by stage and as a whole."""

import random
import zlib

import numpy as np
import pytest
from test_dedup import brute_classes, brute_lines, brute_similarities, brute_substrings, in_order, near_rows, words

P = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

ALL = "doc_id long, text string, lang string, source string, n_chars int, Score string, n_removed int, KEY string"


def rows_of_all_kinds():
    rng = random.Random(21)
    rows = []
    for i, t in near_rows(rng)[:60]:
        lines = (t or "").split(" ")
        rows.append((i, "\n".join(" ".join(lines[k : k + 9]) for k in range(0, len(lines), 9)) if t else t))
    passage = " ".join(words(rng, 60))
    rows += [(200 + k, " ".join(words(rng, 80)) + "\n" + passage[k:] + " end") for k in range(4)]
    rows += [(300, "x"), (301, None), (302, ""), (303, "12 34 !"), (None, " ".join(words(rng, 90))), (None, rows[0][1]), rows[1], rows[1]]
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or ""), "own", 7, "k") for i, t in rows], ALL).repartition(3)


def pairs(frame):
    return sorted(((str(r.doc_id), str(r.text)) for r in frame.collect()))


def keep_own_columns(frame):
    assert frame.columns == [c.split()[0] for c in ALL.split(", ")]
    assert all((r.Score, r.n_removed, r.KEY, r.source) == ("own", 7, "k", "web") and (r.text is None or r.n_chars == len(r.text)) for r in frame.collect())


def test_each_stage_equals_brute_force(spark):
    _, lines, near, suffix, _ = (f for _, f in corpus_pipeline.STAGES)
    rows = rows_of_all_kinds()
    out = lines(spark, frame_of(spark, rows), "")
    keep_own_columns(out)
    assert pairs(out) == sorted((i, str(t)) for i, t, *_ in brute_lines(rows))

    sims = brute_similarities(rows)
    out = near(spark, frame_of(spark, rows), "")
    keep_own_columns(out)
    sure, never = (brute_classes(rows, [k for k, v in sims.items() if v >= bound]) for bound in (0.815, 0.785))
    kept = pairs(out)
    for bound, more in ((sure, False), (never, True)):  # pairs at the threshold itself may go either way
        want = {(str(rows[k][0]), str(rows[k][1])) for k in set(bound)}
        assert want >= set(kept) if not more else want <= set(kept)
    assert len(kept) == len(set(kept))

    out = suffix(spark, frame_of(spark, rows), "")
    keep_own_columns(out)
    assert sorted((str(r.doc_id), len((r.text or "").encode())) for r in out.collect()) == sorted((i, n - gone) for i, n, gone, *_ in brute_substrings(rows))


def test_language_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({"Score": corpus_pipeline.F.lit("own"), "n_removed": corpus_pipeline.F.lit(7), "KEY": corpus_pipeline.F.lit("k")})
    odd = spark.createDataFrame([(9001, None, None, "web", 0, "own", 7, "k"), (9002, "12 ! 3", None, "web", 6, "own", 7, "k"), (9003, "", None, "web", 0, "own", 7, "k")], ALL)
    both = docs.unionByName(odd)
    out = corpus_pipeline.language_id(spark, both, "")
    assert out.columns == both.columns
    before = {r.doc_id: r.asDict() for r in both.collect()}
    got = {r.doc_id: r.asDict() for r in out.collect()}
    assert all(before[i] == r for i, r in got.items())
    letters = {i for i, r in before.items() if any(map(str.isalpha, r["text"] or "")) and len(r["text"]) > 60}
    assert not set(got) & {9001, 9002, 9003} and len(letters & set(got)) >= 0.97 * len(letters)


def test_run_equals_its_stages_by_brute_force(spark, tmp_path):
    """Whole: what language ID keeps, then lines, near-duplicates, strings and ids by plain Python."""
    from tokenizers import Tokenizer

    rows = rows_of_all_kinds()
    frame_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.language_id(spark, docs, "").collect()]
    lined = [(None if i == "None" else int(i), t) for i, t, *_ in brute_lines(kept)]
    sims = brute_similarities(lined)
    assert not [v for v in sims.values() if abs(v - 0.8) < 0.003]
    near = [lined[k] for k in sorted(set(brute_classes(lined, [k for k, v in sims.items() if v >= 0.8])))]
    seen, want = set(), []
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, t in in_order(near):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        text = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((str(i), len(ids), zlib.crc32(ids.tobytes())))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = sorted((str(r.doc_id), r.doc_tokens, r.ids_crc32) for r in out if r.length == r.doc_tokens)
    assert sum(r.length for r in out) == sum(n for _, n, _ in want)
    assert len(whole) > 10 and set(whole) <= set(want)
    assert sorted({(str(r.doc_id), r.doc_tokens) for r in out}) == sorted({(i, n) for i, n, _ in want})


def test_empty_tables(spark):
    docs = frame_of(spark, [(1, "a")]).where("doc_id > 1")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
