"""URL rules, conversation repair and hard negatives against brute force and SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import convrepair, hardneg, queries, urlfilter

SF = "/root/testdata/sf0.001"
CLASHES = ("Host", "rule", "_keys", "key", "conv", "row", "n", "h1", "damage", "part", "anchor", "vector", "window", "id", "score")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.sql(f"create view {t} as select * from '/root/testdata/{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, f"/root/testdata/{sf}")
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


# URL rules


def judged(url, rules, otherwise="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    best = None
    for h, p, verdict in rules:
        if h and (host == h or host.endswith("." + h)) and path.startswith(p or ""):
            best = max(best or (-1,), (len(h + (p or "")), len(h), verdict == "block", h + (p or "")))
    return host, path, best and best[3], ("block" if best[2] else "allow") if best else otherwise


@pytest.mark.parametrize("slice_keys", [1 << 20, 40])
def test_urls_equal_brute_force(spark, monkeypatch, slice_keys):
    monkeypatch.setattr(urlfilter, "SLICE_KEYS", slice_keys)
    rnd = random.Random(3)
    host = lambda k: ".".join(rnd.choice(["a", "b", "c", "com", "net", "x1"]) for _ in range(rnd.randint(1, k)))
    urls = [None, "", "no scheme", "http://", "HTTP://A.B.COM/x", "://a.b", "x://a.b.c/aa?x=://b.com/", "x://a\nb.com/p\nq#z", "x://É.COM/a", "http://" + "a." * 3000 + "com/" + "a/" * 20000]
    for _ in range(800):
        urls.append(rnd.choice(["http", ""]) + "://" + host(4) + rnd.choice(["", "/"]) + "".join(rnd.choice("ab/") for _ in range(rnd.randint(0, 6))) + rnd.choice(["", "?q=a/b", "#f"]))
    rules = [(host(3), rnd.choice(["", "/", "/a", "/ab", "/b/", "/a/b/"]), rnd.choice(["allow", "block"])) for _ in range(100)]
    rules += [(None, "/", "block"), ("com", None, "block"), ("", "/", "block"), (*rules[0][:2], "block"), (*rules[0][:2], "allow")]
    table = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] * 2, "page_id int, url string").withColumns({c: F.lit(c) for c in CLASHES if c != "rule"})
    out = urlfilter.judge_urls(table.repartition(5), spark.createDataFrame(rules, "host string, path string, verdict string"), "unknown")
    rows = out.collect()
    assert len(rows) == 2 * len(urls) and {r["damage"] for r in rows} == {"damage"}
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == judged(urls[r.page_id], rules, "unknown")


def test_urls_without_rows_or_rules(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, None)], "page_id int, url string")
    assert urlfilter.judge_urls(pages.where("page_id > 5"), rules).count() == 0
    assert {(r.page_id, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, rules.where("false")).collect()} == {(1, None, "allow"), (2, None, "allow")}


def test_cascade_has_no_mistake_in_its_universe(spark):
    listed = spark.range(0, 3000, 3).selectExpr("cast(id as string) key")
    cascade = urlfilter.build_cascade(listed, spark.range(60000).selectExpr("cast(id as string) key"))
    assert len(cascade.levels) > 2
    assert cascade.listed([str(k) for k in range(60000)]).tolist() == [k < 3000 and k % 3 == 0 for k in range(60000)]


# Conversations

ON = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}


def cheapest(rows, kinds):
    """(cost, audit, turns) by searching the cheapest, then least, audit first."""
    heap, done = [(0, "", 0, "0", ())], set()
    while True:
        c, a, i, s, out = heapq.heappop(heap)
        if i == len(rows) and s in "03":
            return c, a, out
        if (i, s) in done:
            continue
        done.add((i, s))
        new = [("user", ON.get((s, "u"))), ("assistant", ON.get((s, "a")))]
        for role, to in new:
            if to:
                heapq.heappush(heap, (c + 5, a + "I", i, to, (*out, (role, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (c + 2, a + "D", i + 1, s, out))
            if kinds[i] in ("", "truncated"):
                more = 5 if kinds[i] else 0
                if (s, role[:1]) in ON:
                    heapq.heappush(heap, (c + more, a + "K", i + 1, ON[s, role[:1]], (*out, (role, text))))
                for role, to in new:
                    if to:
                        heapq.heappush(heap, (c + more + 1, a + "R", i + 1, to, (*out, (role, text))))


def repaired(rows):
    conversations = {}
    space = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        own = conversations.setdefault(conv, [])
        damage = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = "user" if damage == 4 else space(role), "" if damage == 1 else space(text)
        own += [(turn, role, re.sub("[.!?]", "", text) if damage == 2 else text)] * {0: 0, 3: 2}.get(damage, 1)
    out = {}
    for conv, own in conversations.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        turns = [r[0] for r in own if r[0] is not None]
        seen, kinds = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, kept = cheapest(own, kinds)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest)
    return out


def odd_turns():
    rnd = random.Random(5)
    rows = []
    for conv in range(80):
        for k in range(rnd.choice([1, 2, 5, 9])):
            rows.append((conv, k + rnd.choice([0, 0, 3]) * 100, rnd.choice(["system", "user", "assistant", "tool", "", None]), rnd.choice(["a.", "b", "c!", "", " ", None, "d? ", "e.\x1d"])))
    for k in range(700):  # a conversation over several tasks and pieces
        rows.append((1000, k, rnd.choice(["system", "user", "assistant", "tool", "user", "assistant"]), rnd.choice(["a.", "b", "c!", ""]) + str(rnd.randrange(300)) + rnd.choice(["", ".", "!"])))
    rows += [(None, k, rnd.choice(["user", "assistant"]), f"t{k}.") for k in range(150)]
    rows += [(7000, None, r, r) for r in ("user", "assistant", None)] + [(7001, 1, "user", "x" * 300_000 + "."), (7001, 2, "assistant", "long " * 300_000)]
    rows += [(8000, 5, "user", "Same.")] * 500 + [(8000, 6, "assistant", "Yes.")]
    own = list(dict.fromkeys(r for r in rows if r[0] != 8000))
    return own + [r for r in rows if r[0] == 8000]


def test_conversations_equal_brute_force(spark):
    frames = [spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").select("conv_id", "turn", "role", "text")]
    frames.append(spark.createDataFrame(odd_turns(), "conv_id long, turn long, role string, text string").repartition(6).withColumns({c: F.lit(c) for c in CLASHES}))
    for df in frames:
        want = repaired([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
        got = queries.repaired(df).collect()
        assert len(got) == len(want)
        assert {r[0]: tuple(r)[1:] for r in got} == want


def test_conversations_of_string_ids_and_none(spark):
    rows = [("a", 1, "user", "Hello."), ("a", 2, "assistant", "Hi."), ("b", 1, "assistant", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in convrepair.repair_conversations(df).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {"a": (0, "KK", hashlib.sha256(b"user:Hello.\nassistant:Hi.").hexdigest()), "b": (2, "D", empty)}
    assert convrepair.repair_conversations(df.where("turn > 9")).count() == 0
    none = convrepair.repair_conversations(df, F.lit(0)).collect()
    assert sorted(map(tuple, none)) == [("a", 0, 0, 0, 0, 0, 0, "", empty), ("b", 0, 0, 0, 0, 0, 0, "", empty)]


def test_layers_of_pieces_fold_to_those_of_the_whole():
    rnd = random.Random(9)
    for _ in range(30):
        rows = bytes(2 * rnd.randrange(4) + rnd.randrange(2) for _ in range(20))
        (((cost, audit, state),),) = convrepair.piece_repairs([rows], [list(convrepair.END)], (0,))
        a, b = convrepair.piece_costs([rows[:9], rows[9:]])
        rest = [min(b[4 * s + t] + convrepair.END[t] for t in range(4) if b[4 * s + t] >= 0) for s in range(4)]
        assert cost == min(a[t] + rest[t] for t in range(4) if a[t] >= 0)
        ((_, first, to),), ((_, second, last),) = convrepair.piece_repairs([rows[:9]], [rest], (0,))[0], convrepair.piece_repairs([rows[9:]], [list(convrepair.END)], (0, 1, 2, 3))[0][0:1]
        second, last = convrepair.piece_repairs([rows[9:]], [list(convrepair.END)], (0, 1, 2, 3))[0][to][1:]
        assert (first + second, last) == (audit, state)


# Hard negatives


def mined(rows, anchor, positives=5, negatives=10):
    rows = list(dict.fromkeys((i, lab, tuple(int(np.floor(256 * float(x))) for x in v)) for i, lab, v in rows if None not in (i, lab, v) and None not in v and np.isfinite(v).all()))
    out = []
    for a in rows:
        if not anchor(a[0]):
            continue
        scores = [(-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in rows if len(r[2]) == len(a[2])]
        for ps, pid in sorted((s, i) for s, i, lab in scores if lab == a[1] and i != a[0])[:positives]:
            fit = sorted((s, i) for s, i, lab in scores if lab != a[1] and 30 * -ps <= 100 * -s <= 90 * -ps)
            out += [(a[0], pid, k + 1, i, -ps, -s) for k, (s, i) in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("radix_bits, gather, block", [(8, 64, 1024), (2, 3, 7)])
def test_negatives_equal_brute_force(spark, monkeypatch, radix_bits, gather, block):
    for name, value in (("RADIX_BITS", radix_bits), ("RADIX", 1 << radix_bits), ("GATHER", gather), ("BLOCK", block)):
        monkeypatch.setattr(hardneg, name, value)
    rnd = np.random.default_rng(4)
    rows = [(int(i), int(rnd.integers(3)), rnd.normal(0, 0.4, 4).tolist()) for i in range(400)]
    rows += [(1000 + i, 1, [0.5, 0.25, 0.0, 0.0]) for i in range(300)] + [(2000 + i, 2, [0.25, 0.25, 0.0, 0.0]) for i in range(300)]  # ties
    rows += rows[:50] + [(3, 1, [0.1, 0.2, 0.3, 0.4]), (None, 1, [1.0, 0.0, 0.0, 0.0]), (5000, None, [1.0, 0.0, 0.0, 0.0]), (5001, 1, None), (5002, 1, [None, 1.0, 0.0, 0.0])]
    rows += [(5003, 1, [float("nan"), 1.0, 0.0, 0.0]), (5004, 1, [float("inf"), 1.0, 0.0, 0.0]), (5005, 1, []), (5010, 1, []), (5020, 2, []), (5030, 1, [1.0]), (5040, 2, [0.5]), (-10, 2, [0.3, 0.3, 0.3, 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5).withColumns({c: F.lit(c) for c in CLASHES})
    got = sorted(map(tuple, hardneg.mine_hard_negatives(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == mined(rows, lambda i: i % 10 == 0)
    assert hardneg.mine_hard_negatives(df.where("vec_id > 10000"), F.col("vec_id") % 10 == 0).count() == 0


def test_negatives_of_large_ids_and_scores(spark):
    rows = [(2**61 - 7 - k, k % 2, [1e6 * (k % 5 + 1), 2e6]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(map(tuple, hardneg.mine_hard_negatives(df, F.col("vec_id") % 3 == 0).collect()))
    assert got and got == mined(rows, lambda i: i % 3 == 0)


# Sharding: the plan does not grow with the number of parts


def test_plan_of_sharding_does_not_hold_its_parts(spark):
    from folioforge.llm import sharding

    docs = spark.range(3000).selectExpr("id as doc_id", "repeat(cast(id as string), 20) as text")
    plans = []
    for size in (1 << 30, 1 << 11):
        out = sharding.shard_documents(docs, 7, bytes_per_part=size)
        plans.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        slots = {}
        for r in out.collect():
            slots.setdefault(r.shard, []).append(r.slot)
        assert sorted(slots) == list(range(7)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert abs(plans[0] - plans[1]) < 200
