"""Operators over many documents, against brute force; the mix by its rules; the pipeline whole."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from otspark.llm import decontamination, html_text, simhash_dedup, source_mix, substring_dedup

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_print(text):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    sums = [0] * 64
    for h in (xxhash.xxh64_intdigest(p, 42) for p in parts):
        for b in range(64):
            sums[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * sums[b] > len(parts))


@pytest.mark.parametrize("table", ["docs", "awkward", "none"])
def test_simhash_components(request, table):
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, plain_print(r.text)) for r in df.select("doc_id", "text").collect()]
    points = np.array([p for _, p in rows], np.uint64)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(points[: i] ^ points[i]) <= 2):
            up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    expected = sorted((str(d), f"{p:016x}", str(least.get(root(i)))) for i, (d, p) in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_dedup.simhash_components(df).collect()) == expected


def test_vantage_cuts_lose_no_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (8, 400)).astype(np.uint64)
    points = np.unique(np.concatenate([base, base ^ flips[0], base ^ flips[1] ^ flips[2], base ^ flips[3] ^ flips[4] ^ flips[5]]))
    tree = simhash_dedup.top_tree(points[::3], 16, 7)
    rows, shards = simhash_dedup.dealt(points, tree, 2)
    held = {}
    for r, s in zip(rows.tolist(), shards.tolist()):
        held.setdefault(r, set()).add(s)
    for i, j in zip(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)):
        assert held[i] & held[j]


def test_shards_are_split_again(spark):
    """A tree of few leaves over clustered points: shards are dealt again until they are small, and no link is lost."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    points = np.unique(np.array([c ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for c in centres for a, b in rng.integers(0, 63, (75, 2))], np.uint64))
    df = spark.createDataFrame(pd.DataFrame({"fp": points.view(np.int64)}))
    few = simhash_dedup.links(df, shard=100, sample=8)
    roots = {r.node: r.root for r in simhash_dedup.components(few).collect()}
    forest = simhash_dedup.Forest(len(points))
    for i, j in zip(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)):
        forest.join(int(i), int(j))
    groups = {}
    for i, p in enumerate(points.view(np.int64).tolist()):
        groups.setdefault(forest.root(i), set()).add(roots.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)
    first = df.select(F.lit(0).cast("long").alias("shard"), "fp")
    again = simhash_dedup.split_again(first, 2, 7, 100)
    assert again.groupBy("shard").count().agg(F.max("count")).first()[0] <= 200


def test_deduplicated(awkward, none):
    out = simhash_dedup.deduplicated(awkward)
    assert out.columns == awkward.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(5) == 1 and 6 not in ids and ids.count(1) == 1 and 2 not in ids
    assert simhash_dedup.deduplicated(none).count() == 0


def test_deduplicated_keeps_unlike_rows_of_one_id(spark, awkward):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"t{x}" for x in rng.integers(0, 10**9, 60)) for _ in range(9)]
    rows = [(None, t, None) for t in texts[:4] * 2] + [(3, t, "b") for t in texts[4:7]] + [(3, texts[4], "a"), (4, texts[7], "a"), (None, texts[7], "a"), (2, texts[8], "a"), (1, texts[8], "a")]
    want = [(None, t) for t in texts[:4]] + [(3, t) for t in texts[4:7]] + [(4, texts[7]), (1, texts[8])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [simhash_dedup.deduplicated(df.repartition(n)).collect() for n in (1, 5)]
    assert sorted((r.doc_id, r.text) for r in kept[0] if r.doc_id) == sorted(w for w in want if w[0])
    assert sorted(r.text for r in kept[0] if not r.doc_id) == sorted(texts[:4])
    assert sorted(map(str, kept[0])) == sorted(map(str, kept[1]))
    assert [r.text for r in simhash_dedup.deduplicated(awkward).collect() if r.doc_id is None] == ["row without id, mail a.b@example.org and 192.168.1.1"]


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def best_window(words, item):
    """Highest weighted similarity of any window as long as the item."""
    k = min(5, len(item))
    grams = lambda ws: Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    b, best = grams(item), 0.0
    for at in range(max(0, len(words) - len(item)) + 1):
        a = grams(words[at : at + len(item)])
        common = sum((a & b).values())
        if common:
            best = max(best, common / sum((a | b).values()))
    return best


def test_decontamination(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango"
    ws = item.split()
    swapped = ws[:18] + ["zulu"] + ws[19:]
    half = ws[:10]
    texts = [(1, f"before it {item} after it"), (2, " ".join(["word"] * 300 + swapped + ["end"] * 50)), (3, " ".join(half)), (4, "nothing here"), (5, None), (6, ""), (7, item.upper().replace(" ", ", ")), (None, item), (8, "two words only")]
    bench = [(0, item), (1, "two words"), (2, None), (3, ""), (4, " ".join(ws[:7]) * 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("_key", F.lit(1))
    benchmark = spark.createDataFrame(bench, "item_id long, text string").withColumn("length", F.lit(2))
    expected = {(d, i) for d, t in texts for i, b in bench if words_of(b) and best_window(words_of(t), words_of(b)) >= 0.8}
    got = {(r.doc_id, r.item_id) for r in decontamination.found_items(docs, benchmark).collect()}
    assert got == expected and (1, 0) in got and (None, 0) in got
    kept = decontamination.clean(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in texts} - {d for d, _ in expected}
    assert decontamination.found_items(docs.limit(0), benchmark).count() == 0
    assert decontamination.clean(docs, benchmark.limit(0)).count() == len(texts)


def test_decontamination_whole(spark, docs):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: words_of(r.text) for r in benchmark.collect()}
    grams = {}
    for i, ws in items.items():
        for at in range(len(ws) - 4):
            grams.setdefault(tuple(ws[at : at + 5]), set()).add(i)
    expected = set()
    for r in docs.collect():
        ws = words_of(r.text)
        for i in {i for at in range(len(ws) - 4) for i in grams.get(tuple(ws[at : at + 5]), ())}:
            if best_window(ws, items[i]) >= 0.8:
                expected.add((r.doc_id, i))
    assert {(r.doc_id, r.item_id) for r in decontamination.found_items(docs, benchmark).collect()} == expected


def sizes_and_targets(rows):
    """Targets by water filling over the sources in order."""
    size = Counter()
    for source, n in rows:
        size[source] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * size[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(2.0 * size[s] for s in full)
        open_ -= full
    return size, target


@pytest.mark.parametrize("table", ["docs", "awkward", "none"])
def test_source_mix(request, table):
    df = request.getfixturevalue(table)
    mix = source_mix.mixed(df)
    got = mix.collect()
    rows = [(r.doc_id, r.source, len(WORD.findall((r.text or "").encode()))) for r in df.select("doc_id", "source", "text").collect()]
    size, target = sizes_and_targets([(s, n) for _, s, n in rows])
    assert sorted((str(r.doc_id), r["size"], r.source_size) for r in got) == sorted((str(d), n, size[s]) for d, s, n in rows)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[round(r.target, 3)] += r.taken
    for t in {round(t, 3) for t in target.values()}:
        assert min(abs(t - x) for x in {round(r.target, 3) for r in got}) < 0.01
        assert abs(sum(v for k, v in taken.items() if abs(k - t) < 0.01) - sum(x for x in target.values() if abs(x - t) < 0.01)) <= max(64, 0.01 * t)
    assert sorted(map(repr, got)) == sorted(map(repr, source_mix.mixed(df.repartition(5)).collect()))


def test_mix_selected(spark, awkward):
    """Every column keeps the caller's values; rows that are alike keep shares of their own."""
    own = awkward.withColumn("size", F.lit(77)).withColumn("taken", F.col("doc_id"))
    out = source_mix.selected(own)
    assert out.columns == [*own.columns, "mix_size", "source_size", "mix_target", "mix_taken"]
    got = out.collect()
    assert got and all(r["size"] == 77 and r.taken == r.doc_id and r.target == 1 and 0 < r.mix_taken <= 2 * r.mix_size for r in got)
    share = Counter((r.doc_id, r.taken) for r in source_mix.mixed(own).collect() if r.taken)
    assert Counter((r.doc_id, r.mix_taken) for r in got) == share
    alike = spark.createDataFrame([(1, "one two three " * 40, "s")] * 50, "doc_id long, text string, source string")
    assert sorted(r.taken for r in source_mix.selected(alike).collect()) == sorted(r.taken for r in source_mix.mixed(alike).collect() if r.taken)


def test_shared_passages_whatever_the_partitions(docs):
    """The same rows after any repartition, and with the texts of a seed linked in several shares the same documents."""
    some = docs.where("doc_id % 3 = 0")
    rows = lambda df, **o: sorted(map(tuple, substring_dedup.shared_passages(df, **o).collect()))
    got = rows(some)
    assert got and got == rows(some.repartition(7))
    covered = lambda found: {d for r in found for d in (r[0], r[3])}
    many = covered(rows(some, share_rows=40))
    assert len(covered(got) ^ many) <= 0.02 * len(many)


def test_shared_passages(spark):
    rng = np.random.default_rng(5)
    some = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    passage = some(80)
    fuzzy = [w if i % 17 else "changed" for i, w in enumerate(passage)]
    texts = [(i, " ".join(some(100) + (passage if i % 2 else fuzzy) + some(60))) for i in range(6)]
    texts += [(10 + i, " ".join(some(300))) for i in range(4)] + [(20, None), (21, ""), (22, "short"), (None, " ".join(some(30)))]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("_key", F.lit(3))
    got = substring_dedup.shared_passages(df).collect()
    assert {d for r in got for d in (r.doc_id, r.other_id)} == set(range(6))
    for r in got:
        assert r.end_word - r.start_word >= 70
        assert abs(r.start_word - 100) <= 3 and abs(r.end_word - 180) <= 3
    assert substring_dedup.shared_passages(df.limit(0)).count() == 0


def test_chain_takes_a_near_predecessor():
    """A long passage too far behind does not hide the near half of a passage with four words put in."""
    parts = [(0, 300, 0), (360, 390, 0), (394, 424, 4)]
    assert sorted(substring_dedup.chains(parts)) == [parts[:1], parts[1:]]
    rng = np.random.default_rng(3)
    for _ in range(200):
        starts, diagonals, lengths = rng.integers(0, 400, 12), rng.integers(-6, 7, 12), rng.integers(3, 120, 12)
        parts = sorted({(int(x), int(x + n), int(d)) for x, n, d in zip(starts, lengths, diagonals)})
        best = {}
        for x, e, d in parts:
            before = [best[q] - 0.25 * (x - q[1] + x - d - q[1] + q[2]) for q in best if 0 <= x - q[1] <= 48 and 0 <= x - d - q[1] + q[2] <= 48]
            best[x, e, d] = e - x + max([0.0, *before])
        first = substring_dedup.chains(parts)[0]
        score = sum(e - x for x, e, _ in first) - 0.25 * sum(2 * q[0] - q[2] - 2 * p[1] + p[2] for p, q in zip(first, first[1:]))
        assert abs(score - max(best.values())) < 1e-9


def test_aligned_keeps_the_like_part_of_an_unlike_chain():
    u = np.arange(140, dtype=np.uint32)
    v = np.where((u < 60) | (u >= 100), u, u + 1000).astype(np.uint32)
    assert substring_dedup.aligned(u, v, 0, 0, [0], 50, 0.8) == [(0, 60, 0, 60, 60)]


def test_shared_passages_behind_a_long_one(spark):
    rng = np.random.default_rng(6)
    some = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    long, left, right = some(300), some(30), some(30)
    texts = [(1, " ".join(long + some(60) + left + some(4) + right)), (2, " ".join(long + some(60) + left + right))]
    got = substring_dedup.shared_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(r.equal_words for r in got) == [60, 300]


def test_shared_passages_awkward(awkward):
    assert {r.doc_id for r in substring_dedup.shared_passages(awkward).collect()} <= {5, 6, 9}


@pytest.mark.parametrize("options", [{}, {"most": 3}, {"most": 3, "block": 4}, {"share_rows": 9}, {"share_rows": 9, "most": 3, "block": 4}])
def test_shared_passages_of_frequent_lines(spark, options):
    """Two texts whose common passage is made of lines that many others hold singly are linked, and equal texts are members."""
    rng = np.random.default_rng(8)
    some = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    lines = [some(30) for _ in range(3)]
    texts = [(i, " ".join(some(40) + sum((line + some(3) for line in lines), []) + some(40))) for i in (1, 2)]  # only the lines' seeds are shared
    texts += [(1000 * (k + 1) + i, " ".join(some(60) + line + some(60))) for k, line in enumerate(lines) for i in range(60)]
    texts += [(100, texts[0][1]), (101, texts[0][1])]
    got = substring_dedup.shared_passages(spark.createDataFrame(texts, "doc_id long, text string"), **options).collect()
    assert sorted((*sorted((r.doc_id, r.other_id)), r.equal_words, r.class_id) for r in got) == [(1, 2, 90, 1), (1, 100, 179, 1), (1, 101, 179, 1)]


def test_frequent_seeds_lose_no_class(docs):
    """Classes are the same where all pairs of a seed's texts are compared as they are."""

    def classes(**options):
        found = substring_dedup.shared_passages(docs, **options)
        return {(d, r.class_id) for r in found.collect() for d in (r.doc_id, r.other_id)}

    assert classes(most=10_000) == classes(most=2) == classes(most=2, block=50)


def test_agreement_and_forest():
    rng = np.random.default_rng(9)
    u = 2 * rng.integers(0, 5, (40, 50)).astype(np.uint32)
    got = substring_dedup.agreement(u, u, 20, tile=16)
    for i, j in itertools.combinations(range(40), 2):
        same = "".join("1" if x == y and x else "0" for x, y in zip(u[i], u[j]))
        runs = re.sub("1+", lambda m: m[0] if len(m[0]) > 2 else "0" * len(m[0]), same)
        assert got[i, j] == got[j, i] == max(runs[k : k + 20].count("1") for k in range(31))
    root = list(range(40))
    for a, b in substring_dedup.forest(got.copy(), True, 7):
        assert got[a, b] >= 7 and root[a] != root[b]
        root = [root[a] if r == root[b] else r for r in root]
    assert not any(got[i, j] >= 7 and root[i] != root[j] for i, j in itertools.combinations(range(40), 2))


def test_html(spark):
    para = "The council met on Tuesday and agreed, after a long debate, on the plan for the new bridge over the river. "
    page = f"""<html><head><title>x</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body>
    <nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><article><h1>Bridge &amp; river</h1>
    <p>{para}</p><p>{para}&eacute;&#233;   second</p></article><div class="comments"><p>First!</p></div>
    <aside>Related</aside><footer>Copyright 2020</footer></body></html>"""
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p><b>unclosed <a href='"), (1, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.main_text(df).orderBy("page_id").collect()
    assert len(got) == 5 and got[0] == got[1]
    text = got[0].text
    assert text.count("council met") == 2 and "éé second" in text and "Bridge & river" in text
    assert not re.search(r"Home|News|First!|Related|Copyright|var a|<", text)
    assert all(r.n_chars == len(r.text) for r in got) and got[2].text == "" and got[3].text == ""
    assert html_text.main_text(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "pii", "mix"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from otspark.llm import pii, toxicity
    from otspark.llm.common import written

    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    bad = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    rest = docs.where(~F.col("doc_id").isin(list(bad)))
    first = {r.component_id for r in simhash_dedup.simhash_components(rest).collect()}
    rest = written(rest.where(F.col("doc_id").isin(list(first))))
    leaked = {r.doc_id for r in decontamination.found_items(rest, benchmark).collect()}
    clean = pii.mask(rest.where(~F.col("doc_id").isin(list(leaked))))
    clean = {r.doc_id: r for r in written(clean).collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert len({r.doc_id for r in out}) == len(out)
    size, target = sizes_and_targets([(r.source, len(WORD.findall(r.text.encode()))) for r in clean.values()])
    taken = Counter()
    for r in out:
        assert r.text == clean[r.doc_id].text and 0 < r.taken <= 2 * r["size"] and r.source_size == size[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= max(64, 0.01 * t) for s, t in target.items())


def test_pipeline_awkward(spark, awkward, none):
    import corpus_pipeline

    for start in (awkward, none):
        df = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert set(df.columns) <= set(out.columns), name
            df = out
        assert df.count() <= start.count()
