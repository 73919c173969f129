"""Operators that give a row per document, against plain versions of the same rules."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from otspark.llm import flac, lm_score, pii, queries, token_counts, toxicity

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("table", ["docs", "awkward", "none"])
def test_token_counts(request, table):
    import sentencepiece

    df = request.getfixturevalue(table)
    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file())
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, queries.tokenizer_file()).collect()), key=repr)
    texts = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    n = [len(model.encode(t)) for _, t in texts]
    assert got == sorted(((i, len(t.encode()), k, k > 4096) for (i, t), k in zip(texts, n)), key=repr)


@pytest.mark.parametrize("table", ["docs", "awkward", "none"])
def test_lm_base_score(request, table):
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, WORD.findall(lowered(r.text))) for r in df.select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(str("null" if i is None else i).encode()) % 7 == 2
    counts = Counter(w for i, ws in rows if not held(i) for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    expected = [(str(i), held(i), len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, None])) for i, ws in rows]
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm_score.lm_scores(df).collect()]
    assert len(got) == len(expected)
    for a, b in zip(sorted(got), sorted(expected)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)


def test_lm_beats_base_on_held_out(docs):
    r = lm_score.lm_scores(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.max("score").alias("m")).first()
    assert r.s > r.b and r.m <= 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


@pytest.mark.parametrize("table", ["docs", "awkward", "none"])
def test_pii(request, table):
    df = request.getfixturevalue(table)
    expected = []
    for r in df.select("doc_id", "text").collect():
        text = r.text or ""
        spans = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if fits(k, m[0])]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        expected.append((str(r.doc_id), *(sum(s[3] == k for s in spans) for k in PATTERNS), hashlib.sha256(joined.encode()).hexdigest(), set(joined.split(",")) - {""}))
    got = [(str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, set(r.spans.split(","))) for r in pii.personal_data(df).collect()]
    assert len(got) == len(expected)
    for a, b in zip(sorted(got, key=lambda x: x[:6]), sorted(expected, key=lambda x: x[:6])):
        assert a[:6] == b[:6] and b[6] <= a[6]


def test_mask_keeps_rows_and_columns(awkward):
    out = pii.mask(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert out.where("text like '%example.org%'").count() == 0 and out.where("text is null").count() == 2


@pytest.mark.parametrize("table", ["docs", "awkward", "none"])
def test_flac_round_trip(request, table):
    df = request.getfixturevalue(table)
    pay = lambda t: (b := (t or "").encode()) + bytes(-len(b) % 64 if b else 64)
    expected = sorted((str(r.doc_id), len((r.text or "").encode()), len(p := pay(r.text)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for r in df.select("doc_id", "text").collect())
    got = flac.media_digests(df).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == expected
    stored = {(str(r.doc_id), hashlib.sha256(r.media).hexdigest(), len(r.media)) for r in flac.media(df).collect()}
    assert {(str(r.doc_id), r.media_sha256, r.media_bytes) for r in got} == stored
    assert all(r.media[:4] == b"fLaC" for r in flac.media(df).collect())


def test_flac_blocks_are_seekable(spark, docs):
    some = flac.media(docs.orderBy(F.desc("n_chars")).limit(3))
    texts = {r.doc_id: r.text for r in docs.collect()}
    blocks = flac.pcm_blocks(some).collect()
    for i in {b.doc_id for b in blocks}:
        mine = sorted((b for b in blocks if b.doc_id == i), key=lambda b: b.block)
        at = 0
        stored = {r.doc_id: bytes(r.media) for r in some.collect()}[i]
        for b in mine:
            assert b.sample_offset == at and b.last == (b is mine[-1])
            _, _, x = next(flac.frames(stored, start=b.byte_offset))
            assert flac.pcm_of(x, 8) == bytes(b.pcm)  # reading may begin at any block
            at += b.n_samples
        assert at == len(flac.payload_of(texts[i]))


def test_flac_damage_is_found():
    data = bytearray(flac.encode(flac.payload_of("some text that is stored " * 40)))
    data[-10] ^= 0x11
    with pytest.raises(flac.FlacError):
        flac.decode_payload(bytes(data))


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_toxicity_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out and toxic is not null").select("score", "toxic").collect()
    assert auc([(r.score, r.toxic) for r in rows]) > 0.9
    assert got.where("score < 0 or score > 1 or score is null or predicted <> int(score >= 0.5)").count() == 0
    assert got.where("held_out <> (crc32(string(doc_id)) % 5 = 0)").count() == 0


def test_toxicity_awkward(spark, awkward, none):
    labels = spark.createDataFrame([(5, 0, 0), (7, 1, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(awkward, labels).count() == awkward.count()
    assert toxicity.toxicity(awkward, labels.limit(0)).where("score = 0.5").count() == awkward.count()
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.accepted(awkward, labels).columns == awkward.columns


def exact_scores(rows):
    """The model of lm_score by plain counting: counts quantised to levels, no filter."""
    import math
    from collections import Counter

    def est(c):
        if not c:
            return 0.0
        j = 1 + math.floor(math.log(c) / math.log(1.5) + 1e-9)
        low = math.ceil(1.5 ** (j - 1.0) - 1e-9)
        return (low + max(low, math.ceil(1.5**j - 1e-9) - 1)) / 2

    words = lambda t: re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
    train = [words(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(w for t in train for w in t), Counter()
    for t in train:
        two.update(zip([None, *t], [*t, ()]))
    n, v = sum(one.values()) + len(train), len(one) + 1
    once, twice = sum(c == 1 for c in one.values()), sum(c == 2 for c in one.values())
    d = once / (once + 2 * twice)
    f = min(0.9, max(0.01, sum(c for c in two.values() if c > 1) / n))
    count = lambda w: len(train) if w in (None, ()) else one[w]
    out = {}
    for i, t in rows:
        s = 0.0
        for u, w in zip([None, *words(t)], [*words(t), ()]):
            c, cu = est(count(w)), est(count(u))
            p = (max(c - d, 1e-3) if c else d * v) / n
            s += math.log10(min(1.0, f * min(est(two[u, w]), c, cu) / max(cu, 1) + (1 - f) * p if cu else p))
        out[i] = s
    return out


@pytest.mark.parametrize("options", [{}, {"filter_bytes": (6_000, 6_000), "group": 2_000, "head_words": 300}])
def test_lm_score_against_counting(docs, options):
    """Wherever the n-grams are probed (broadcast, groups, joins), scores are those of plain counts but for false positives of the filters."""
    expected = exact_scores([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = lm_score.lm_scores(docs, **options).collect()
    assert len(got) == len(expected)
    off = [abs(r.score - expected[r.doc_id]) / r.n_tokens for r in got]
    assert sum(off) / len(off) < 0.02 and sum(o < 0.1 for o in off) > 0.98 * len(off)


def test_flac_foreign_streams():
    """Streams written out by hand from the format's description: 16-bit stereo, constant and verbatim subframes, side channel, Rice-coded LPC."""

    def bits(*parts):
        text = "".join(format(v & ((1 << n) - 1), f"0{n}b") for v, n in parts)
        return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")

    def stream(n, channels, bps, frame):
        info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | (channels - 1) << 41 | (bps - 1) << 36 | n).to_bytes(8, "big") + bytes(16)
        return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame

    def frame(n, assignment, width, *subframes):
        head = b"\xff\xf8" + bits((6, 4), (0, 4), (assignment, 4), (width, 3), (0, 1)) + b"\x00" + bytes([n - 1])
        body = head + bytes([flac.crc8(head)])
        body += bits(*[p for s in subframes for p in s])
        return body + flac.crc16(body).to_bytes(2, "big")

    # left and side: left verbatim, side (17 bits) constant 3, so right = left - 3
    left = [100, -200, 300, -400]
    data = stream(4, 2, 16, frame(4, 8, 4, [(0b00000010, 8), *[(v, 16) for v in left]], [(0, 8), (3, 17)]))
    (_, _, x), = flac.frames(data)
    assert x.tolist() == [left, [v - 3 for v in left]]
    # LPC of order 2, coefficients 2 and -1 with no shift: a line but for its residuals 1, 0, -1, 2, coded with parameter 1
    want, residual = [5, 7], [1, 0, -1, 2]
    for e in residual:
        want.append(2 * want[-1] - want[-2] + e)
    coded = []
    for e in residual:
        u = 2 * e if e >= 0 else -2 * e - 1
        coded += [(0, u >> 1), (1, 1), (u & 1, 1)] if u >> 1 else [(1, 1), (u & 1, 1)]
    sub = [(0b01000010, 8), (5, 8), (7, 8), (3, 4), (0, 5), (2, 4), (-1, 4), (0, 2), (0, 4), (1, 4), *coded]
    (_, _, x), = flac.frames(stream(6, 1, 8, frame(6, 0, 1, sub)))
    assert x.tolist() == [want]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = sorted(d[0] for d in con.execute(queries.ORACLES[name]).description)
    expected = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall())
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect())) == expected


def test_toxicity_offsets_are_those_of_the_text():
    """Characters that grow in lower case shift no offset; all sentences with a toxic word are learned from, and as many others."""
    import numpy as np

    text = "İİ fine words. vile thing"
    assert toxicity.lowered(text) == "İİ fine words. vile thing" and toxicity.lowered("ABC") == "abc"
    p = np.array([0.0, 0.0, 0.0, 0.9, 0.8])
    (span,) = toxicity.offsets(text, p)
    a, b = map(int, span.split(":"))
    assert text[a:b] == "vile thing"
    rows = [(f"good words number {i}. calm day {i}", 0) for i in range(80)] + [(f"good words number {i}. you are zzvile {i}", 1) for i in range(80)]
    model = toxicity.train(iter(rows), 0.5)
    ((group, q, doc),) = toxicity.tagger(model)(["calm day 3", "you are zzvile 3", "", None])
    x = toxicity.summaries(q, doc, len(group)) @ model.fit
    assert x[1] > 0 > x[0] and x[2] == x[3]


def test_toxicity_learns_one_text_of_an_id(spark):
    """Rows that share an id, and texts beyond the sample's characters, don't swell what is learned from."""
    docs = spark.createDataFrame([(1, f"text {i} " * 50) for i in range(300)] + [(2, "calm " * 500_000), (3, "zzvile " * 20), (4, "calm day " * 20)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels, chars=50_000).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 for r in got)


def test_html_deep_and_unclosed():
    """Cost and result don't depend on how deep a page is; end tags without a start close nothing."""
    from otspark.llm import html_text

    extract = html_text.extractor(html_text.train())
    body = "<article>" + "".join(f"<p>Sentence number {i} of a text, with some words in it.</p>" for i in range(30)) + "</article>"
    flat = extract(f"<html><body>{body}</body></html>")
    assert flat.count("Sentence number") == 30
    deep = extract("<html><body>" + "<div>" * 3000 + body + "</div>" * 3000 + "<nav><a href='/'>Home</a></nav></body></html>")
    assert deep == flat
    assert extract("<html><body>" + "</section>" * 5000 + body + "</nav>" * 5000) == flat
    assert extract(None) == extract("") == extract("   ") == ""


def test_pii_long_runs():
    """Long runs of numbers and long tokens are passed through; digits far into a token count."""
    import time

    w = pii.train()
    start = time.time()
    base, every = pii.all_spans(" ".join(str(12_345_678 + 7 * i) for i in range(8_000)), w)
    assert base == [] and every == [] and time.time() - start < 20
    _, every = pii.all_spans("token=" + "abcdef" * 15 + "9f8 end", w)
    assert every == [(6, 99, "secret")]


def test_one_huge_labelled_text_leaves_the_others(spark):
    from pyspark.sql import functions as F

    from otspark.llm import toxicity

    rows = [(i, ("zzvile you awful grubble. " if i % 2 else "calm pleasant day here. ") * 3 + f"word{i}.") for i in range(200)]
    order = spark.range(200).select("id", F.xxhash64("id", F.lit(17)).alias("h"), F.crc32(F.col("id").cast("string").cast("binary")).alias("c")).where("id % 2 = 1 AND c % 5 != 0").orderBy("h").first().id
    rows[order] = (order, "zzvile " * 20_000)  # the first of its label, longer than all the room
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels, chars=100_000).collect()}
    assert got == {i: i % 2 for i, _ in rows}
