"""Prefix trie, importance resampling and top-k search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from otspark.llm import common, importance_resampling, prefix_trie, voronoi_join

SF = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = {}
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        digest = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, digest, (r, x)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    members, children = {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        saved[node] = (len(members[node]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0) + sum(saved[b] for b in below)
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(node)))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def tries():
    rng = random.Random(5)
    odd = [(None, 1, "user", "no id"), (3, None, "user", "null first"), (3, 2, None, None), (3, 2, "user", "tie"), (3, 1, "", "b  c\td"), (-7, 0, "user", "x y"), (-20, 0, "user", "x y"), (20, 5, "user", "x y"), (20, 5, "user", "x y"), (25, 1, "user", "x y"), (26, 1, "user", "z " * 5000)]
    alone = [(c, t, "user", f"short {t}") for c in range(101, 120) for t in range(c % 3)]  # no conversation 100 to begin with; some have no turn left
    deep = [(c, t, "user", f"turn {t}" if (c, t) != (2003, 140) else "other") for c in (2001, 2002, 2003) for t in range(150)]
    hot = [(5000, t, "user", f"long {t}") for t in range(3000)] + [(5001, t, "user", f"long {t}") for t in range(40)]
    same = [(c, t, "user", f"same {t}") for c in range(6000, 9000) for t in range(2)]
    mixed = [(rng.randrange(200), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "user", "assistant"]), rng.choice([None, "", "a", "a b", "c"])) for _ in range(900)]
    return {"odd": odd, "alone": alone, "deep": odd + deep, "hot": hot + odd, "same": same, "mixed": mixed, "one": odd[:2], "none": [], "no ids": odd[:1]}


@pytest.mark.parametrize("name", sorted(tries()))
def test_trie_nodes(spark, name):
    rows = tries()[name]
    df = spark.createDataFrame(rows, TURNS)
    for c in ("_c", "_key", "depth", "_b", "_n"):
        df = df.withColumn(c, F.lit(1))
    assert sorted((tuple(r) for r in prefix_trie.trie_nodes(df.repartition(3)).collect()), key=str) == plain_trie(rows)


def test_trie_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert sorted((tuple(r) for r in prefix_trie.trie_nodes(df).collect()), key=str) == plain_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_join_weighed_and_numbered(spark):
    rows = common.written(spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 700).alias("k"), "id"))
    keys = common.written(rows.groupBy("k").agg(F.count("*").alias("n")))
    for most in (1, 10, 10_000):
        assert common.join_weighed(rows, keys, "k", "n", most).agg(F.count("*"), F.sum("n"), F.countDistinct("id")).first()[:] == rows.join(keys, "k").agg(F.count("*"), F.sum("n"), F.countDistinct("id")).first()[:]
    got = common.numbered(rows, [F.col("k").desc(), F.col("id")], "at").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(5000)) and [(-r.k, r.id) for r in got] == sorted((-r.k, r.id) for r in got)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(SMALL))
    return Counter(crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)), len(words)


def plain_resampled(docs, bench):
    found = [(d, *features(t)) for d, t in docs]
    s, t = sum((c for _, c, _ in found), Counter()), sum((features(b)[0] for b in bench), Counter())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10000) / ((s[b] + 1) * (sum(t.values()) + 10000)))) for b in range(10000)]
    out = []
    for d, c, n in found:
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items())
        out.append([d, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((o for o in out if o[5] >= 20), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    for i, o in enumerate(able[: 5 * len(able) // 100]):
        o[4] = i + 1
    return sorted((tuple(o[:5]) for o in out), key=str)


@pytest.mark.parametrize("table", ["docs", "awkward", "none", "many"])
@pytest.mark.parametrize("piece", [40, importance_resampling.PIECE])
def test_resampled(spark, request, table, piece):
    if table == "many":  # ties, copies, and enough documents for a draw
        rows = [(i % 70 if i % 9 else None, f"Copy {i % 5} of w{i % 11} " * 9, "en", "a", 1) for i in range(200)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("totals", F.lit(1))
    else:
        df = request.getfixturevalue(table)
    if table == "docs" and piece == 40:
        df = df.limit(60)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = sorted((tuple(r) for r in importance_resampling.resampled(df, bench, piece=piece).collect()), key=str)
    assert got == plain_resampled([tuple(r) for r in df.select("doc_id", "text").collect()], [r.text for r in bench.collect()])


def test_resampled_without_target(spark, docs):
    few = docs.limit(40)
    got = sorted((tuple(r) for r in importance_resampling.resampled(few, few.select(F.col("doc_id").alias("item_id"), "text").limit(0)).collect()), key=str)
    assert got == plain_resampled([tuple(r) for r in few.select("doc_id", "text").collect()], [])
    kept = importance_resampling.selected(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert kept.columns == docs.columns and 0 < kept.count() < 60


def test_pieces_hold_every_run():
    rng = random.Random(2)
    con = importance_resampling.database()
    for _ in range(30):
        text = "".join(rng.choice(["A", "b", "é", "7", " ", ".", "\n", "日", "\x00", " "]) for _ in range(rng.randrange(400)))
        [(buckets, counts)] = importance_resampling.bucket_counts([text], con, piece=rng.randrange(1, 50))
        assert dict(zip(buckets.tolist(), counts.tolist())) == dict(features(text)[0])


def plain_top(rows, k=5):
    whole = lambda x: max(-(2**63), min(2**63 - 1, math.floor(256.0 * x)))
    held = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for j, (q, v) in enumerate(held):
        if q is not None and q % 50 == 0:
            scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i is None, i or 0) for at, (i, w) in enumerate(held) if at != j]
            out += [(q, r + 1, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def vectors():
    rng = np.random.default_rng(4)
    plain = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    centres = rng.normal(size=(6, 8)) * 5
    close = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.01]) for i in range(900)]
    copies = [(i, [0.5, 0.25]) for i in range(600)] + [(i, [1.0, float(i % 7)]) for i in range(600, 700)]
    odd = [(0, None), (50, [None, 1.0]), (100, [float("nan"), 1.0]), (150, [float("inf"), 1.0]), (200, []), (250, [1.0]), (300, [1.0, -2.0, 0.001]), (300, [1.0, -2.0, 0.001]), (None, [9.0, 9.0]), (None, [9.0, 9.0]), (7, [0.0, -0.0])]
    return {"plain": plain, "close": close, "copies": copies, "odd": odd, "odd and plain": odd + plain[1:], "huge": [(i * 25, [3.1e15 * (i - 3), 2.0**40 + i, 1e300 if i == 6 else 1.0]) for i in range(8)], "large": [(i * 10, [1e5 * i, -7.7e5]) for i in range(30)], "one": [(0, [1.0])], "none": [], "all null": odd[:3]}


@pytest.mark.parametrize("name", sorted(vectors()))
@pytest.mark.parametrize("pivots", [3, 20])
def test_top_k(spark, name, pivots):
    rows = vectors()[name]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("_row", F.lit(1)).withColumn("_vec", F.lit(1))
    got = voronoi_join.top_k(df.repartition(3), pivots=pivots, shelf=64)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_top(rows)


def test_bounds_leave_cells_out():
    rows = np.array([v for _, v in vectors()["close"]])
    pivots = rows[:6]
    cell = ((rows[:, None] - pivots) ** 2).sum(2).argmin(1)
    dist = np.sqrt(((rows - pivots[cell]) ** 2).sum(1))
    norm = np.sqrt((rows**2).sum(1))
    top = lambda x: np.array([x[cell == j].max() for j in range(6)])
    cells = voronoi_join.Cells(pivots, top(dist), top(norm), [np.sort(dist[cell == j])[:6].tolist() for j in range(6)], top(dist), top(norm), 5)
    need = cells.needed(rows, cell)
    scores = rows @ rows.T
    np.fill_diagonal(scores, -np.inf)
    assert need.mean() < 0.5
    for i in range(len(rows)):
        assert need[i, cell[np.argsort(-scores[i])[:5]]].all()
