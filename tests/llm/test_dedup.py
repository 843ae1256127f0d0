"""Deduplicating operators against brute force, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import embeddings, induced, linededup, minhash, suffixdedup
from folioforge.llm.components import connected_components
from folioforge.llm.induced import repeated_windows, suffix_order

DOC = "doc_id long, text string"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi omi pi rho sig tau".split()) + str(rng.randrange(60)) for _ in range(n)]


@pytest.mark.parametrize("memory,one_symbol,depth", [(64, 512, 200), (64, 2, 200), (64, 8, 5), (1 << 20, 512, 200), (1 << 20, 2, 3)])
def test_suffix_order(monkeypatch, memory, one_symbol, depth):
    monkeypatch.setattr(induced, "ONE_SYMBOL", one_symbol)
    rng = random.Random(memory + one_symbol)
    for _ in range(60):
        a = rng.choice([1, 2, 3, 9, 40])
        body = [rng.randrange(1, a + 1) for _ in range(rng.randrange(1, 70))]
        t = np.array((body[: len(body) // 4 + 1] * 5 if rng.random() < 0.3 else body) + [0], np.uint16)
        order, common = suffix_order(t, a + 1, depth, induced.Scratch(memory))
        assert sorted(order.tolist()) == list(range(len(t)))
        start = [t[i : i + depth].tolist() for i in order]
        assert start == sorted(start)
        for k in range(1, len(t)):
            x, y = t[order[k - 1] :].tolist(), t[order[k] :].tolist()
            assert common[k] == min(depth, next(j for j in range(len(t)) if x[j : j + 1] != y[j : j + 1]))


def test_a_shard_far_larger_than_memory_is_sorted_on_disk():
    rng = random.Random(12)
    shared = " ".join(words(rng, 300)).encode()
    records = [" ".join(words(rng, 60)).encode() + shared[k : k + 150] for k in range(1200)]
    windows = [len(r) - 99 for r in records]
    seen, want = set(), []
    for r in records:
        for w in (r[i : i + 100] for i in range(len(r) - 99)):
            want.append(w in seen)
            seen.add(w)
    memory = 1 << 14
    shard = induced.Shard(100, memory)
    for k in range(0, len(records), 100):
        shard.add(records[k : k + 100], np.array(windows[k : k + 100]))
    begin = np.cumsum(windows) - windows
    got = np.zeros(len(want), bool)
    for record, at in shard.repeats(np.arange(len(records))):
        got[begin[record] + at] = True
    assert got.tolist() == want and sum(want) > 1000
    assert shard.size > 30 * memory and shard.scratch.spilled > 100 * memory and shard.scratch.levels > 2


def test_repeated_windows():
    rng = random.Random(4)
    for _ in range(60):
        size = rng.choice([3, 5])
        records = [bytes(rng.choice(b"ab") for _ in range(size + rng.randrange(12))) for _ in range(rng.randrange(1, 12))]
        n = [rng.randrange(1, len(r) - size + 2) for r in records]
        seen, want = set(), []
        for r, k in zip(records, n):
            for w in (r[i : i + size] for i in range(k)):
                want.append(w in seen)
                seen.add(w)
        assert repeated_windows(records, n, size).tolist() == want


def in_order(rows):
    """Rows as the operators order them: by id, null last; of one id by the hash of the text."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, text_hash(r[1] or "")))


def text_hash(t):
    """Spark's xxhash64 of a string."""
    import xxhash

    return int.from_bytes(xxhash.xxh64(t.encode(), seed=42).digest(), "big", signed=True)


def brute_substrings(rows):
    seen, out = set(), []
    for i, t in in_order(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = True
            seen.add(w)
        spans = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def substring_results(frame, **more):
    out = suffixdedup.dedup_substrings(frame, keep_text=False, **more).collect()
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)


def substring_rows(rng):
    shared = " ".join(words(rng, 40))
    rows = []
    for i in range(30):
        t = " ".join(words(rng, rng.randrange(1, 60)))
        if i % 3 == 0:
            t += shared[rng.randrange(30) :] + " é漢" + t[:50]
        rows.append((i, t))
    return rows + [(30, ""), (31, None), (32, "x" * 450), (33, "-=" * 300), (34, rows[3][1]), (35, "x" * 99), (36, "é" * 120)]


def test_substrings_equal_brute_force(spark):
    rows = substring_rows(random.Random(8))
    assert substring_results(spark.createDataFrame(rows, DOC).repartition(3)) == brute_substrings(rows)


def test_substrings_of_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT_CONTEXTS", 1)
    rows = substring_rows(random.Random(9))
    assert substring_results(spark.createDataFrame(rows, DOC).repartition(3)) == brute_substrings(rows)


def contexts_of(text):
    """One text as a call of the combiner: its arguments but the document."""
    texts = [text.encode()]
    (pieces,) = suffixdedup._pieces(texts)
    ((which, p, n, _, h, c),) = suffixdedup.contexts(texts, pieces)
    return texts, which, p, n, h, c


def combined(combiner, texts):
    """(document, from, to) of the contexts dealt on, and of the repeats, of one text a call."""
    fresh, again = [], []
    for doc, text in texts:
        raw, which, p, n, h, c = contexts_of(text)
        ids = np.full(len(p), doc)
        for out, rows in zip((fresh, again), combiner.split(raw, which, ids, ids * 0, p, n, h, c)):
            out += [(doc, int(p[k]), int(p[k] + n[k] + 99)) for k in rows]
    return fresh, again


@pytest.mark.parametrize("noted, remembered", [(1 << 16, 1000), (64, 1000), (1 << 16, 3)])
def test_a_passage_once_a_call_is_combined(noted, remembered):
    rng = random.Random(41)
    passage = " ".join(words(rng, 60))
    texts = [(k, " ".join(words(rng, 300)) + passage + " ".join(words(rng, 300))) for k in rng.sample(range(100), 40)]
    fresh, again = combined(suffixdedup._Combiner(noted, remembered), texts)
    text = dict(texts)
    dealt = {}
    for doc, a, b in fresh:
        dealt.setdefault(text[doc][a:b], []).append((doc, a))
    # every repeat has an earlier equal context that is dealt on, and no context is lost
    assert all(min(dealt[text[doc][a:b]]) < (doc, a) for doc, a, b in again)
    assert sorted(fresh + again) == sorted((doc, int(a), int(a + m + 99)) for doc, t in texts for _, _, ps, ns, _, _ in [contexts_of(t)] for a, m in zip(ps, ns))
    inside = [r for r in fresh + again if text[r[0]][r[1] : r[2]] in passage]
    told = [r for r in again if text[r[0]][r[1] : r[2]] in passage]
    if noted > 64 and remembered > 3:
        # all but the two sightings that it takes to remember a context, and new least places
        assert len(told) > 0.7 * len(inside) > 100


def test_substrings_of_a_passage_in_every_document(spark):
    rng = random.Random(42)
    passage = " ".join(words(rng, 50))
    rows = [(k, " ".join(words(rng, 20)) + passage[k % 7 :] + " ".join(words(rng, 20))) for k in range(600)]
    assert substring_results(spark.createDataFrame(rows, DOC).repartition(8), memory=1 << 10) == brute_substrings(rows)


def test_substrings_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(10)
    a, b, c = (" ".join(words(rng, 70)) for _ in range(3))
    rows = [(1, a), (1, a), (1, a), (1, b + a[:150]), (2, b), (None, a), (None, a), (None, c), (None, c + b[:120]), (3, "short"), (3, "short"), (None, None), (None, None), (4, a[50:] + "é" * 60)]
    got = substring_results(spark.createDataFrame(rows, DOC).repartition(4))
    assert got == brute_substrings(rows)
    # int ids, and a sort that has to go to disk
    rows += substring_rows(rng)
    frame = spark.createDataFrame(rows, DOC).withColumn("doc_id", F.col("doc_id").cast("int"))
    assert substring_results(frame.repartition(3), memory=1 << 10) == brute_substrings(rows)
    with pytest.raises(TypeError):
        suffixdedup.dedup_substrings(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_substrings_of_texts_longer_than_a_segment(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "SEGMENT", 500)
    rng = random.Random(14)
    t = " ".join(words(rng, 900))
    rows = [(1, t), (2, t[3000:] + t), (3, "x" * 3000), (4, None)]
    assert substring_results(spark.createDataFrame(rows, DOC)) == brute_substrings(rows)


def test_substrings_in_segments(spark):
    rng = random.Random(3)
    texts = [" ".join(words(rng, 200)).encode() for _ in range(2)]
    texts[1] = texts[0][100:700] + texts[1]

    def windows():
        got = {}
        for pieces in suffixdedup._pieces(texts):
            for text, p, n, place, h, c in suffixdedup.contexts(texts, pieces):
                for k, a, m in zip(text.tolist(), p.tolist(), n.tolist()):
                    got.update({(k, a + j): None for j in range(m)})
        return sorted(got)

    whole = windows()
    assert whole == [(k, j) for k in range(2) for j in range(len(texts[k]) - 99)]


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], DOC)
    assert suffixdedup.dedup_substrings(none).count() == 0
    assert linededup.dedup_lines(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(1, "a line that is long enough", "x", 5, "k")], "doc_id long, text string, spans string, N_Removed int, key string")
    assert set(suffixdedup.dedup_substrings(odd).columns) == {"doc_id", "text", "spans", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256"}
    assert set(linededup.dedup_lines(odd).columns) == {"doc_id", "text", "spans", "key", "n_lines", "n_removed"}
    assert linededup.dedup_lines(odd).first().spans == "x"


def test_within_one_edit():
    assert linededup.within_one_edit("abc", "abc") and linededup.within_one_edit("abc", "abd") and linededup.within_one_edit("abc", "ac")
    assert linededup.within_one_edit("", "a") and not linededup.within_one_edit("abc", "bac") and not linededup.within_one_edit("abc", "a")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_within_edits():
    rng = random.Random(12)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(8))) for _ in range(2))
        for k in range(4):
            assert linededup.within_edits(a, b, k) == (edit_distance(a, b) <= k), (a, b, k)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines_within_the_bound_share_a_part_and_a_key(edits):
    rng = random.Random(edits)
    for _ in range(60):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(4, 14)))
        b = a
        for _ in range(edits):
            k = rng.randrange(len(b) + 1)
            b = rng.choice([b[:k] + b[k + 1 :], b[:k] + rng.choice("abc") + b[k + 1 :], b[:k] + rng.choice("abc") + b[k:]])
        c = "".join(rng.choice("abc") for _ in range(len(a)))
        for other in (b, c):
            if a == other:
                continue
            _, parts = linededup.line_keys([a, other], edits)
            near = edit_distance(a, other) <= edits
            assert not near or set(parts[0].tolist()) & set(parts[1].tolist())
            if edits > 1:
                keys = [set(), set()]
                for n, key, side in linededup.bounded_variants([a, other], edits):
                    keys[n] |= set(zip(key.tolist(), side.tolist()))
                paired = any((k, 1 - s if s < 2 else 2) in keys[1] for k, s in keys[0])
                assert paired == near, (a, other)


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_lines_within_a_bound_equal_brute_force(spark, edits):
    rng = random.Random(30 + edits)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(16, 24))).strip() + "z" for _ in range(12)]
    rows = []
    for i in range(30):
        lines = []
        for _ in range(rng.randrange(4)):
            x = rng.choice(base)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(x))
                x = rng.choice([x[:k] + x[k + 1 :], x[:k] + rng.choice("abc") + x[k + 1 :], x[:k] + rng.choice("abc") + x[k:]])
            lines.append(x)
        rows.append((i, "\n".join(lines)))
    want, before = [], []
    for i, t in rows:
        kept = []
        for x in t.split("\n"):
            y = x.strip()
            if not y or not any(y == z or min(len(y), len(z)) >= 8 and edit_distance(y, z) <= edits for z in before):
                kept.append(x)
            before.append(y)
        want.append((i, "\n".join(kept)))
    got = linededup.dedup_lines(spark.createDataFrame(rows, DOC).repartition(3), edit_from=8, edits=edits)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == want


def brute_lines(rows):
    before, want = [], []
    for i, t in in_order(rows):
        kept, removed = [], 0
        for line in (t or "").split("\n"):
            x = line.strip()
            near = any(x == y or min(len(x), len(y)) >= linededup.EDIT_FROM and linededup.within_one_edit(x, y) for y in before)
            if x and near:
                removed += 1
            else:
                kept.append(line)
            before.append(x)
        want.append((str(i), None if t is None else "\n".join(kept), len(t.split("\n")) if t else 0, removed))
    return sorted(want, key=str)


def line_results(frame):
    return sorted(((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(frame).collect()), key=str)


def test_lines_equal_brute_force(spark):
    rng = random.Random(6)
    base = [" ".join(words(rng, 4)) for _ in range(25)] + ["a" * 20, "ab" * 12]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(6)):
            x = rng.choice(base)
            k = rng.randrange(len(x))
            lines.append(rng.choice([x, x[:k] + x[k + 1 :], x[:k] + "Z" + x[k + 1 :], x[:k] + "Q" + x[k:], " " + x, "short", "shirt", "", "  "]))
        rows.append((i, "\n".join(lines)))
    rows += [(40, None), (None, base[0]), (41, "é\n\n" + "long " * 40_000 + "\né")]
    assert line_results(spark.createDataFrame(rows, DOC).repartition(3)) == brute_lines(rows)


def test_lines_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(16)
    a, b, c = ("\n".join(" ".join(words(rng, 4)) for _ in range(4)) for _ in range(3))
    rows = [(1, a), (1, a), (1, b + "\n" + a[:30]), (2, b), (None, a), (None, c), (None, c), (None, None), (None, None), (3, "x\nx\ny"), (3, "x\nx\ny"), (4, "")]
    assert line_results(spark.createDataFrame(rows, DOC).repartition(4)) == brute_lines(rows)
    assert line_results(spark.createDataFrame(rows, DOC).withColumn("doc_id", F.col("doc_id").cast("int"))) == brute_lines(rows)
    with pytest.raises(TypeError):
        linededup.dedup_lines(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_substitutions_beside_equal_characters(spark):
    """A substituted character may equal its neighbour, so the place of a deletion is not unique."""
    rng = random.Random(8)
    pairs = [("the year 2105 was quiet", "the year 2005 was quiet"), ("he said heklo to us all", "he said hello to us all")]
    for _ in range(60):
        a = "".join(rng.choice("abc") for _ in range(40))
        k = rng.randrange(40)
        pairs.append((a, a[:k] + rng.choice(a) + a[k + 1 :]))
    rows = list(enumerate(x for p in pairs for x in p))
    want = {i: "" if any(linededup.within_one_edit(t, u) for _, u in rows[:i]) else t for i, t in rows}
    assert all(want[i] == "" for i in range(1, len(rows), 2))
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, DOC).repartition(3)).collect()}
    assert got == want


def plain_shingles(rows):
    out = []
    for _, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        out.append(Counter(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    return out


def brute_similarities(rows):
    """Exact weighted Jaccard of TF-IDF shingles for every pair of row numbers."""
    sets = plain_shingles(rows)
    df = Counter(u for s in sets for u in s)
    weight = {u: 1 + math.log((1 + len(rows)) / (1 + n)) for u, n in df.items()}
    total = [sum(n * weight[u] for u, n in s.items()) for s in sets]
    out = {}
    for a in range(len(rows)):
        for b in range(a):
            common = sum(min(n, sets[b][u]) * weight[u] for u, n in sets[a].items() if u in sets[b])
            out[a, b] = common / (total[a] + total[b] - common) if total[a] and total[b] else float((rows[a][1] or "") == (rows[b][1] or ""))
    return out


def brute_classes(rows, near):
    """For each row number: the number of the row its class keeps."""
    root = list(range(len(rows)))
    for a, b in near:
        x, y = root[a], root[b]
        root = [x if r == y else r for r in root]
    order = {k: n for n, k in enumerate(sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, text_hash(rows[k][1] or ""))))}
    return [min((k for k in range(len(rows)) if root[k] == root[j]), key=order.get) for j in range(len(rows))]


def near_rows(rng):
    rows, i = [], 0
    for _ in range(20):
        w = words(rng, 160)
        for _ in range(rng.randrange(1, 5)):
            v = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                v[rng.randrange(160)] = "changed"
            rows.append((i, " ".join(v)))
            i += 1
        rows.append((i, " ".join(words(rng, 120))))
        i += 1
    return rows + [(i, ""), (i + 1, None), (i + 2, "one two"), (i + 3, "One  two"), (None, "one two"), (None, rows[0][1]), (i + 4, rows[0][1]), (i + 4, rows[0][1]), (i + 4, "of the same id"), (None, "no id and no copy"), (i + 5, "w x y z " * 70_000)]


def test_near_duplicates_equal_exact_weighted_jaccard(spark):
    rows = near_rows(random.Random(5))
    frame = spark.createDataFrame([(*r, "x") for r in rows], DOC + ", Class_Id string").repartition(3)
    sims = brute_similarities(rows)
    assert sum(rows[a][1] != rows[b][1] for (a, b), v in sims.items() if v >= 0.8) > 20
    # shingles that share a counter move a similarity a little: no pair of these rows is that near to the threshold
    threshold = 0.78
    assert not [v for v in sims.values() if abs(v - threshold) < 0.015]
    want = brute_classes(rows, [k for k, v in sims.items() if v >= threshold])
    out = minhash.near_duplicates(frame, threshold).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in out) == sorted((str(rows[k][0]), str(rows[j][0])) for k, j in enumerate(want))
    left = minhash.drop_near_duplicates(frame, threshold)
    assert left.columns == frame.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted((str(rows[k][0]), str(rows[k][1])) for k in set(want))


def test_recall_of_pairs_of_unequal_texts(spark):
    """Recall against exact weighted Jaccard, on a table of the test data; links, not classes, are asked for."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    sets = plain_shingles(rows)
    holders = {}
    for k, s in enumerate(sets):
        for u in s:
            holders.setdefault(u, []).append(k)
    weight = {u: 1 + math.log((1 + len(rows)) / (1 + len(h))) for u, h in holders.items()}
    common = Counter()
    for u, h in holders.items():
        if len(h) < 200:  # a passage of more documents is not what makes two of them near copies
            for x in range(len(h)):
                for y in range(x):
                    common[h[x], h[y]] += 1
    total = [sum(n * weight[u] for u, n in s.items()) for s in sets]
    pairs = []
    for (a, b), n in common.items():
        if n > 0.3 * min(len(sets[a]), len(sets[b])) and rows[a][1] != rows[b][1]:
            c = sum(min(m, sets[b][u]) * weight[u] for u, m in sets[a].items() if u in sets[b])
            if c >= 0.8 * (total[a] + total[b] - c):
                pairs.append((rows[a][0], rows[b][0]))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) >= 10 and found >= 0.9 * len(pairs), (found, len(pairs))


def test_residual_buckets_are_compared_in_blocks(spark, monkeypatch):
    """a is like b and b like c, but the bucket's least member is unlike the rest."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    rng = random.Random(1)
    member = spark.createDataFrame([(k, 7, 0) for k in range(9)], "node long, bucket long, pivot long")
    part = spark.createDataFrame([(k, 0) for k in range(5)], "id long, component long")
    met = minhash._blocks(member, part).collect()
    together = {}
    for r in met:
        together.setdefault((r.lo, r.hi), []).append((r.node, r.block, r.part))
    pairs = set()
    for (lo, hi), group in together.items():
        for a, x, _ in group:
            for b, y, _ in group:
                if a < b and (lo == hi or x != y):
                    pairs.add((a, b))
    assert pairs >= {(a, b) for a in range(9) for b in range(max(a + 1, 5), 9)}
    assert rng


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: find(k) for k in root}


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for _ in range(20):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((k, [float(x) for x in (centre + rng.normal(size=16) * 0.02).astype(np.float32)], int(rng.integers(0, 2))))
            k += 1
    rows += [(k, rows[0][1], rows[0][2]), (k + 1, rows[0][1], None), (k + 2, None, 1), (k + 3, [0.0] * 16, 1), (k + 4, [float("nan")] + [1.0] * 15, 1), (k + 5, [], 0), (k + 6, [1.0, None], 0), (None, rows[0][1], rows[0][2])]
    out = {r.vec_id: r for r in embeddings.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect()}
    assert len(out) == len(rows)
    good = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in rows if i is not None and i <= k and l is not None]
    x = np.stack([v / np.linalg.norm(v) for _, v, _ in good])
    label = np.array([l for *_, l in good])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    assert [out[i].n_links for i, *_ in good] == near.sum(axis=1).tolist()
    for j in range(1, 7):
        assert out[k + j].n_links == 0 and out[k + j].component_id == k + j and out[k + j].kept
    assert out[None].n_links == 0 and out[None].component_id is None and not out[None].kept
    assert embeddings.link_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_common_weights_are_exact():
    rng = np.random.default_rng(9)
    weight = rng.uniform(1, 1.5, 1 << minhash.DF_BITS).astype(np.float32)
    pool = rng.integers(0, 2**32, 60).astype(np.uint32)
    side = [[np.sort(rng.choice(pool, rng.integers(0, 40))) for _ in range(7)] for _ in range(2)]
    got = minhash.common_weights(*side, weight, columns=16)
    for i, a in enumerate(side[0]):
        for j, b in enumerate(side[1]):
            both = sum(min((a == u).sum(), (b == u).sum()) * weight[u >> np.uint32(32 - minhash.DF_BITS)] for u in pool[np.unique(pool, return_index=True)[1]])
            assert abs(got[i, j] - both) < 1e-3
