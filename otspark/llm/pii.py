"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base spans (email, ip, card, phone) are what fixed patterns match. The
field then tags runs of words that hold a digit or an @: features of whole
candidate spans score (span, type), spans have at most LONGEST tokens, and
dynamic programming over boundaries and types jointly picks the best
segmentation. Its spans of further types (access keys, secrets) that touch no
base span are added; base spans always stay.

The field is trained here, by conditional likelihood, on labelled sequences
that a seeded generator makes (TRAINING of them, a fixed bound); the weights are
a few hundred numbers.

Cases: null and empty texts have no spans; very long words and runs cost time in
proportion to their length; repeated rows and ties give equal spans; an empty
table gives an empty result; other columns are ignored (mask() keeps them).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otspark.llm.common import text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("key", "secret")
KINDS = BASE + ADDED
ORDER = {k: i for i, k in enumerate(KINDS)}
#: Tokens of a span, at most.
LONGEST = 20
#: Digits of a number of any kind, at most (cards have 19, the longest), with some room; a longer run of digits is none.
MOST_DIGITS = 24
#: Labelled sequences that the field is trained on.
TRAINING = 900

LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# each starts where a run of digits starts, and no match ends within one: possessive parts match what the plain ones do
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")
SPACES = re.compile(r"\s")
DIGIT = re.compile(r"\d")
NUMERIC = re.compile(r"[0-9 ().+-]+")
TOKEN = re.compile(r"[A-Za-z0-9_]+|\s+|.", re.S)


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(twice) + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches from the left; no match crosses an @ to its left, so each @ is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    if not ANY.search(text):
        return []
    out = [(a, b, "email") for a, b in emails(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, what stands before) of each run of words that hold a digit or an @, one white space apart."""
    m, n = ANY.search(text), len(text)
    while m:
        start = m.start()
        while start and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while True:
            s = SPACES.search(text, end)
            end = s.start() if s else n
            nxt = SPACES.search(text, end + 1)
            word = text[end + 1 : nxt.start() if nxt else n]
            if end >= n or not word or not ANY.search(word):
                break
            end += 1
        yield start, end, text[max(0, start - 24) : start].lower()
        m = ANY.search(text, end)


def shape(s: str) -> str:
    """Kinds of characters, each run of one kind once."""
    out = ""
    for c in s:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "_" if c.isspace() else c
        if not out.endswith(k):
            out += k
            if len(out) > 12:
                break
    return out


def span_features(s: str, before: str) -> list[str]:
    """Features of a whole candidate span; `before` is what stands before it."""
    d = digits_of(s)
    name = re.findall(r"[a-z_]+", before)
    mark = before.rstrip()[-1:]
    only = all(c in "0123456789 -" for c in s)
    hexa = len(s) >= 8 and all(c in "0123456789abcdef" for c in s)
    word = s.isalnum()
    upper = word and s.isupper()
    return [
        "bias", f"digits:{min(len(d), 20)}", f"size:{min(len(s).bit_length(), 8)}", f"at:{s.count('@')}", f"dots:{min(s.count('.'), 4)}", f"plus:{s[:1] == '+'}",
        f"only:{only}", f"luhn:{only and 14 <= len(d) <= 19 and luhn(d)}", f"hex:{hexa}", f"word:{word}", f"upper:{upper}:{min(len(s) // 4, 6)}",
        f"four:{s.count('.') == 3 and s.replace('.', '').isdigit()}", f"name:{name[-1][-8:] if name and mark in '=:\"' and mark else ''}", f"mark:{mark if mark in '=:@\"' else ''}", f"mixed:{word and bool(d) and not s.isdigit()}:{min(len(s) // 8, 4)}",
        f"shape:{shape(s)[:6]}" if not (hexa or upper) else "shape:code",
    ]


def pieces(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in TOKEN.finditer(text, start, end)]


def candidates(text: str, toks: list[tuple[int, int]], before: str) -> dict[tuple[int, int], list[str]]:
    """Features by (first token, token after the last) of each span that could be an entity."""
    out = {}
    lead = before
    digits = [0]
    for a, b in toks:
        digits.append(digits[-1] + len(DIGIT.findall(text, a, b)))
    for i, (a, _) in enumerate(toks):
        c = text[a]
        if not (c.isalnum() or c == "+"):
            continue
        ctx = (lead + text[max(toks[0][0], a - 24) : a])[-24:].lower()
        for j in range(i + 1, min(i + LONGEST, len(toks)) + 1):
            s = text[a : toks[j - 1][1]]
            if s[-1].isspace():
                if len(s) > 1 and s[-2].isspace():
                    break
                continue
            if not s[-1].isalnum():
                continue
            one = j == i + 1
            n = digits[j] - digits[i]
            if (one and len(s) >= 8 and n) or s.count("@") == 1 or (7 <= n <= MOST_DIGITS and NUMERIC.fullmatch(s)):
                out[i, j] = span_features(s, ctx)
            if len(s) > 400 or s.count("@") > 1 or n > MOST_DIGITS:
                break
    return out


Weights = dict[tuple[str, str], float]


def score(w: Weights, kind: str, feats: list[str]) -> float:
    return sum(w.get((kind, f), 0.0) for f in feats)


def segment(n: int, cands: dict[tuple[int, int], list[str]], w: Weights) -> list[tuple[int, int, str]]:
    """Best segmentation of n tokens into typed spans and single tokens outside."""
    ending: dict[int, list[tuple[int, str, float]]] = {}
    for (i, j), feats in cands.items():
        for k in KINDS:
            s = score(w, k, feats)
            if s > 0:
                ending.setdefault(j, []).append((i, k, s))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, k, s in ending.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, k)
    out, j = [], n
    while j > 0:
        if back[j]:
            out.append((back[j][0], j, back[j][1]))
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def learn(sequences: list[tuple[int, dict, list[tuple[int, int, str]]]], epochs: int = 6, rate: float = 0.5, decay: float = 1e-4) -> Weights:
    """Maximum conditional likelihood by adaptive stochastic gradients; marginals of typed spans by forward-backward."""
    w: Weights = {}
    seen: dict[tuple[str, str], float] = {}
    rng = random.Random(5)
    for _ in range(epochs):
        rng.shuffle(sequences)
        for n, cands, gold in sequences:
            scored = [(i, j, k, score(w, k, f), f) for (i, j), f in cands.items() for k in KINDS]
            forward = [0.0] + [-math.inf] * n
            by_end: dict[int, list] = {}
            by_start: dict[int, list] = {}
            for x in scored:
                by_end.setdefault(x[1], []).append(x)
                by_start.setdefault(x[0], []).append(x)
            for j in range(1, n + 1):
                forward[j] = log_sum([forward[j - 1]] + [forward[x[0]] + x[3] for x in by_end.get(j, ())])
            backward = [-math.inf] * n + [0.0]
            for i in range(n - 1, -1, -1):
                backward[i] = log_sum([backward[i + 1]] + [x[3] + backward[x[1]] for x in by_start.get(i, ())])
            true = {(i, j, k) for i, j, k in gold}
            for i, j, k, s, feats in scored:
                g = ((i, j, k) in true) - math.exp(min(0.0, forward[i] + s + backward[j] - forward[n]))
                if abs(g) > 1e-3:
                    for f in feats:
                        key = (k, f)
                        step = g - decay * w.get(key, 0.0)
                        seen[key] = seen.get(key, 1e-2) + step * step
                        w[key] = w.get(key, 0.0) + rate * step / math.sqrt(seen[key])
    return w


def log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in xs))


def labelled(n: int = TRAINING, seed: int = 3) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Seeded texts with known spans: invented words around entities, and numbers and codes that are none."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    low, up, num = string.ascii_lowercase, string.ascii_uppercase, string.digits

    def entity(kind: str) -> tuple[str, str]:
        """What stands before it, and itself."""
        if kind == "email":
            return "", pick(low, r.randint(2, 8)) + r.choice([".", "_", "", "+"]) + pick(num, r.randint(0, 3)) + "@" + pick(low, r.randint(3, 7)) + pick(num, r.randint(0, 1)) + r.choice([".com", ".org", ".example.com", ".co.uk"])
        if kind == "ip":
            return "", ".".join(str(r.randint(0, 255)) for _ in range(4))
        if kind == "card":
            d = r.choice("3456") + pick(num, r.choice([13, 14, 14, 14, 17]))
            d += next(c for c in num if luhn(d + c))
            sep = r.choice(["", "", " ", "-"])
            return "", sep.join(d[i : i + 4] for i in range(0, len(d), 4))
        if kind == "phone":
            a, b, c = pick("23456789", 1) + pick(num, 2), pick(num, 3), pick(num, 4)
            return "", r.choice([f"+1 ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+1{a}{b}{c}"])
        if kind == "key":
            return r.choice(["", "", "key ", "id: "]), r.choice(["AKIA", "ASIA", "GHP", "SK"]) + pick(up + num, r.randint(15, 17)) + pick(num, 1)
        name = r.choice(["password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "auth_token"])
        value = pick("0123456789abcdef", r.randint(14, 40)) if r.random() < 0.7 else pick(low + up + num, r.randint(11, 30))
        value += pick(num, 1)
        return name + r.choice(["=", "=", " = \"", ": ", "=\"", ": \""]), value

    def other() -> str:
        return r.choice([str(r.randint(0, 9999)), f"{r.randint(1, 9)}.{r.randint(0, 9)}", f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", pick(low, 3) + pick(num, 2), f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", pick(low, 6) + pick(num, 1) + pick(low, 4), "@" + pick(low, 5), f"{r.randint(1, 999)},{r.randint(100, 999)}", pick(num, 8), pick(num, 12), pick(up, 2) + pick(num, 6), f"x={pick(num, 3)}", pick("0123456789abcdef", 9)])

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            text += " ".join(pick(low, r.randint(2, 9)) for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.65:
                kind = r.choice(KINDS)
                lead, e = entity(kind)
                text += lead
                spans.append((len(text), len(text) + len(e), kind))
                text += e + r.choice(["", "", ".", ",", '"'])
            else:
                text += other()
            text += " "
        out.append((text, spans))
    return out


def sequences_of(texts: list[tuple[str, list[tuple[int, int, str]]]]) -> list[tuple[int, dict, list[tuple[int, int, str]]]]:
    out = []
    for text, spans in texts:
        for start, end, before in runs(text):
            toks = pieces(text, start, end)
            first, last = {a: i for i, (a, _) in enumerate(toks)}, {b: i + 1 for i, (_, b) in enumerate(toks)}
            gold = [(first[a], last[b], k) for a, b, k in spans if a in first and b in last]
            cands = candidates(text, toks, before)
            out.append((len(toks), cands, [g for g in gold if (g[0], g[1]) in cands]))
    return out


def train() -> Weights:
    return {k: v for k, v in learn(sequences_of(labelled())).items() if abs(v) > 1e-3}


def field_spans(text: str, w: Weights) -> list[tuple[int, int, str]]:
    out = []
    for start, end, before in runs(text):
        toks = pieces(text, start, end)
        out += [(toks[i][0], toks[j - 1][1], k) for i, j, k in segment(len(toks), candidates(text, toks, before), w)]
    return out


def all_spans(text: str, w: Weights) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and those with what the field adds."""
    base = base_spans(text)
    more, at = [], 0
    upto = []  # furthest end of the base spans so far
    for a, b, _ in base:
        upto.append(max(b, upto[-1] if upto else 0))
    for a, b, k in field_spans(text, w) if ANY.search(text) else ():
        while at < len(base) and base[at][0] < b:
            at += 1
        if k in ADDED and not (at and upto[at - 1] > a):
            more.append((a, b, k))
    return base, sorted(base + more, key=lambda s: (s[0], ORDER[s[2]]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def personal_data(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, base counts by kind, base_sha256, spans (kind:start:end, code points), n_added."""
    weights = docs.sparkSession.sparkContext.broadcast(train())

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base, every = all_spans(t, weights.value)
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(docs[id_col].alias("doc_id"), found(text_of(docs, text_col)).alias("_f")).select("doc_id", "_f.*")


def mask_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span (overlapping ones as one) as [kind] of the first."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents, personal data in the text replaced by [kind]; null stays null; all columns stay."""
    weights = docs.sparkSession.sparkContext.broadcast(train())

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else mask_text(t, all_spans(t, weights.value)[1]) for t in texts], dtype=object)

    return docs.withColumn(text_col, masked(docs[text_col]))
