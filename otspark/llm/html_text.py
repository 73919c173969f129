"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with
its open ancestors (tags, classes, ids, roles) and counts of its text. The field
has features of both, is trained here on labelled pages that a seeded generator
makes (PAGES of them, a fixed bound) and tags the blocks by Viterbi; the text is
the blocks tagged as main, in page order.

Script, style, template and the like hold no blocks. Character references are
decoded; white space within a block becomes one space; blocks are joined by one.

Cases: null and empty html, and pages without main blocks, give an empty text;
unclosed and stray tags, comments without an end and broken attributes are read
as far as they go; very long pages cost time in proportion; repeated rows give
equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otspark.llm.chain_crf import trained, viterbi
from otspark.llm.common import text_of

#: Labelled pages that the field is trained on.
PAGES = 500
HASHED = 1 << 15
#: Weights are added up in this part of one, as whole numbers, so that sums don't depend on their order.
UNIT = 1 << 24
#: Features and text shapes whose score a worker remembers.
REMEMBERED = 200_000

# fixed values: elements whose content is not text, that stand alone, that do not end a block
SILENT = frozenset("script style template noscript svg math iframe object canvas title select datalist audio video textarea button".split())
RAW = frozenset("script style title textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME = re.compile(r"[a-z]+")


class Block:
    """Text of a leaf block, what its ancestors say (their features, or what these add up to), and its shape."""

    __slots__ = ("text", "path", "shape")

    def __init__(self, text: str, path, shape: tuple):
        self.text, self.path, self.shape = text, path, shape


class Ancestors:
    """Open elements. `says` turns a feature into what counts of it: a number, which is added up while the stack grows and
    shrinks, so that a block costs the same at any depth; without it a block gets the list of its features."""

    def __init__(self, says: Callable[[str], int] | None = None):
        self.says = says
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.active: Counter = Counter()
        self.open: Counter = Counter()
        self.total = 0

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        features = tuple({f"in:{tag}", *(f"name:{w}" for w in names)})
        self.stack.append((tag, features))
        self.open[tag] += 1
        for f in features:
            self.active[f] += 1
            if self.says and self.active[f] == 1:
                self.total += self.says(f)

    def pop(self) -> None:
        tag, features = self.stack.pop()
        self.open[tag] -= 1
        for f in features:
            self.active[f] -= 1
            if not self.active[f]:
                del self.active[f]
                if self.says:
                    self.total -= self.says(f)

    def close(self, tag: str) -> None:
        """Closes the innermost element of that tag and all within it; nothing if there is none."""
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def top(self) -> str | None:
        return self.stack[-1][0] if self.stack else None

    def path(self):
        last = [tag for tag, _ in self.stack[-2:]]
        ends = [f"last:{last[-1] if last else ''}", f"two:{' '.join(last)}", f"article:{bool(self.open['article'] or self.open['main'])}"]
        return self.total + sum(map(self.says, ends)) if self.says else sorted([*self.active, *ends])


def names_of(attributes: str) -> tuple[str, ...]:
    """Words of the class, id and role of a tag, and whether it is hidden."""
    out = []
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind in ("class", "id", "role"):
            out += NAME.findall(value)
        elif kind == "hidden" or (kind == "aria-hidden" and value == "true") or (kind == "style" and "display:none" in value.replace(" ", "")):
            out.append("hidden")
    return tuple(out)


def blocks(page: str, says: Callable[[str], int] | None = None) -> list[Block]:
    """Leaf blocks in page order; `says` as for Ancestors."""
    out: list[Block] = []
    above = Ancestors(says)
    parts: list[str] = []
    link, linked, at, n = 0, 0, 0, len(page)
    never: set[str] = set()

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, above.path(), shape_of(text, linked)))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            if "&" in raw:
                raw = entities.unescape(raw)
            parts.append(raw)
            if link:
                linked += len(raw)

    while at < n:
        open_ = page.find("<", at)
        if open_ < 0:
            say(page[at:])
            break
        say(page[at:open_])
        if page.startswith("<!--", open_):
            close = page.find("-->", open_ + 4)
            at = n if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), open_):
            close = page.find(">", open_)
            at = n if close < 0 else close + 1
            continue
        m = TAG.match(page, open_)
        if not m:
            follows = page[open_ + 1 : open_ + 2]
            if follows == "/" or follows.isalpha():  # a tag with a broken attribute ends at the next >
                close = page.find(">", open_)
                at = n if close < 0 else close + 1
            else:
                say("<")
                at = open_ + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = 0
            if tag in INLINE:
                continue
            end()
            above.close(tag)
            continue
        if tag in SILENT:
            if tag not in INLINE and tag not in ("button", "select"):
                end()
            close = None if tag in never else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if close is not None:
                m = TAG.match(page, close.start())
                at = m.end() if m else n
            elif tag in RAW:
                at = n
            else:  # never closed: only the tag itself is passed over
                never.add(tag)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                link = 1
            continue
        end()
        if tag in VOID:
            continue
        if tag in ENDS_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            close_to(above, tag)
        above.push(tag, names_of(m[3]))
    end()
    return out


def close_to(above: Ancestors, tag: str) -> None:
    """Closes what an opening tag ends: a paragraph, or an item of the same list or row."""
    ends, walls = ("p",), ()
    if tag == "li":
        ends, walls = ("p", "li"), ("ul", "ol", "menu")
    elif tag in ("dt", "dd"):
        ends, walls = ("p", "dt", "dd"), ("dl",)
    elif tag in ("td", "th"):
        ends, walls = ("p", "td", "th"), ("tr", "table")
    elif tag == "tr":
        ends, walls = ("p", "td", "th", "tr"), ("table",)
    while above.top() in ends and above.top() not in walls:
        above.pop()


def shape_of(text: str, linked: int) -> tuple:
    n = len(text)
    words = text.count(" ") + 1
    return (
        min(words.bit_length(), 8),
        min(10 * linked // max(n, 1), 10),
        text[-1] if text[-1] in ".!?:,;…»)" else "w" if text[-1].isalnum() else "o",
        min(sum(text.count(c) for c in ".!?,"), 6),
        "©" in text[:200] or "copyright" in text[:200].lower(),
        text[0].isupper(),
    )


def shape_features(shape: tuple) -> list[str]:
    words, link, last, marks, mark, upper = shape
    return [f"words:{words}", f"link:{link}", f"last:{last}:{words > 3}", f"marks:{marks}", f"copyright:{mark}", f"upper:{upper}", "bias"]


def hashed(names: list[str]) -> list[int]:
    return [1 + zlib.crc32(n.encode()) % (HASHED - 1) for n in names]


# ---- labelled pages ----


def labelled(n: int = PAGES, seed: int = 4) -> list[tuple[str, list[str]]]:
    """Seeded pages and the texts of their main blocks."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgkäéñö"
    pick = r.choice

    def word() -> str:
        return "".join(pick(letters) for _ in range(r.randint(2, 9)))

    def sentence(a: int = 3, b: int = 18) -> str:
        return " ".join(word() for _ in range(r.randint(a, b))).capitalize() + pick("....!?")

    def prose(a: int = 1, b: int = 6) -> str:
        return " ".join(sentence() for _ in range(r.randint(a, b)))

    def short() -> str:
        return " ".join(word() for _ in range(r.randint(1, 4))).capitalize()

    def links(k: int) -> str:
        tag = pick(["ul", "ol", "div"])
        if tag == "div":
            return "<div>" + pick([" | ", " ", " · "]).join(f'<a href="/{word()}">{short()}</a>' for _ in range(k)) + "</div>"
        return f"<{tag}>" + "".join(f'<li><a href="/{word()}">{short()}</a></li>' for _ in range(k)) + f"</{tag}>"

    def some(names: str) -> str:
        w = pick(names.split())
        return pick([f' class="{w}"', f' id="{w}"', f' class="{w} {word()}"', f' class="{pick(["site", "page", "block", "js"])}-{w}"'])

    def aside_text() -> str:
        return pick([prose(1, 3), short(), sentence(), f"<p>{prose(1, 2)}</p>", links(r.randint(2, 5)), f"<h3>{short()}</h3>{links(r.randint(2, 6))}", f"<h3>{short()}</h3><p>{prose(1, 3)}</p>"])

    def before() -> list[str]:
        return [
            lambda: f"<nav{some('nav menu main-nav top')}>{links(r.randint(3, 9))}</nav>",
            lambda: f"<nav>{links(r.randint(3, 9))}</nav>",
            lambda: f"<header{some('header banner masthead top')}>{pick(['', f'<h1>{short()}</h1>', f'<div>{short()}</div>'])}<p>{sentence()}</p>{pick(['', links(4)])}</header>",
            lambda: f"<div{some('ad ads advert advertisement banner-ad sponsor promo')}>{pick([prose(1, 3), sentence(), short()])}</div>",
            lambda: f"<div{some('cookie cookies notice consent gdpr alert')}>{pick([f'<p>{prose(1, 3)}</p>', prose(1, 2)])}<button>{short()}</button></div>",
            lambda: f"<div{some('breadcrumb breadcrumbs crumbs')}>{links(3)}</div>",
            lambda: f"<form{some('search login newsletter signup')}><label>{short()}</label><input name=q><p>{sentence()}</p><button>{short()}</button></form>",
            lambda: f"<div{some('menu nav navbar navigation')}>{links(r.randint(3, 9))}</div>",
        ]

    def after() -> list[str]:
        comment = lambda: f"<{pick(['div', 'li', 'article', 'p'])}{some('comment reply response')}>{pick(['', f'<b>{short()}</b>: '])}{prose(1, 3)}"
        return [
            lambda: f"<aside{some('sidebar side widget related aside')}>{aside_text()}{pick(['', aside_text()])}</aside>",
            lambda: f"<aside>{aside_text()}{pick(['', aside_text()])}</aside>",
            lambda: f"<div{some('sidebar side widget related recommended popular')}>{aside_text()}{pick(['', aside_text()])}</div>",
            lambda: f"<section{some('comments comment-list discussion responses replies')}><h2>{short()}</h2>{''.join(comment() + '</div>' for _ in range(r.randint(1, 5)))}</section>",
            lambda: f"<div{some('comments comment-list discussion responses')}>{pick(['', f'<h3>{short()}</h3>'])}{''.join(f'<p>{prose(1, 3)}</p>' for _ in range(r.randint(1, 5)))}</div>",
            lambda: f"<ol{some('comments commentlist')}>{''.join(f'<li><p>{prose(1, 3)}</p></li>' for _ in range(r.randint(1, 5)))}</ol>",
            lambda: f"<div{some('share social sharing tags meta byline')}>{links(r.randint(2, 5))}</div>",
            lambda: f"<div{some('ad ads advert advertisement sponsored promo')}>{pick([prose(1, 3), sentence(), short()])}</div>",
            lambda: f"<div{some('newsletter subscribe signup')}><form><p>{prose(1, 2)}</p><input><button>{short()}</button></form></div>",
            lambda: f"<form{some('comment-form contact login')}><p>{prose(1, 2)}</p><textarea>{sentence()}</textarea></form>",
        ]

    out = []
    for _ in range(n):
        main: list[str] = []

        def keep(text: str) -> str:
            main.append(text)
            return text

        def body() -> str:
            parts = [f"<h1>{keep(pick([short(), sentence(3, 9)]))}</h1>"] if r.random() < 0.9 else []
            for _ in range(r.randint(1, 14)):
                parts.append(
                    pick([
                        lambda: f"<p>{keep(prose())}</p>", lambda: f"<p>{keep(prose())}</p>", lambda: f"<p>{keep(prose())}</p>", lambda: f"<p>{keep(prose())}</p>",
                        lambda: f"<p>{keep(prose())}", lambda: f"<p>{keep(sentence(1, 4))}</p>", lambda: f"<p>{keep(short())}</p>", lambda: f"<p><b>{keep(prose(1, 2))}<br>",
                        lambda: f"<h2>{keep(short())}</h2>", lambda: f"<h3>{keep(sentence(2, 6))}</h3>",
                        lambda: "<ul>" + "".join(f"<li>{keep(pick([short(), sentence()]))}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
                        lambda: f"<blockquote><p>{keep(prose(1, 2))}</p></blockquote>", lambda: f"<pre>{keep(short())}</pre>",
                        lambda: f'<figure><img src="x.png"><figcaption>{keep(sentence())}</figcaption></figure>',
                        lambda: f'<div class="{pick(["text", "paragraph", "body", word()])}">{keep(prose())}</div>',
                        lambda: "<table><tr>" + "".join(f"<td>{keep(short())}</td>" for _ in range(3)) + "</tr></table>",
                    ])()
                )
                if r.random() < 0.06:
                    parts.append(pick(after())())
            return "".join(parts)

        how = r.random()
        if how < 0.5:
            inner = f"<article{pick(['', '', some('article post entry story')])}>{body()}</article>"
        elif how < 0.65:
            inner = f"<main{pick(['', some('main content')])}>{body()}</main>"
        elif how < 0.8:
            inner = f"<main><article>{body()}</article></main>"
        else:
            inner = f"<div{some('content post entry article story main-content article-body text')}>{body()}</div>"
        if r.random() < 0.3:
            inner = f"<div{some('wrapper container layout page row')}>{inner}{''.join(f() for f in r.sample(after(), r.randint(0, 2)))}</div>"
        page = "<!DOCTYPE html><html><head><title>" + short() + "</title><style>p{}</style></head><body>"
        page += "".join(f() for f in r.sample(before(), r.randint(1, 5))) + inner + "".join(f() for f in r.sample(after(), r.randint(0, 3)))
        page += pick([f"<footer>&copy; {short()} {prose(1, 2)}</footer>", f"<footer{some('footer foot')}><p>{prose(1, 2)}</p>{links(3)}</footer>", f"<div{some('footer foot bottom copyright')}>&copy; {sentence()}</div>", ""])
        out.append((page + pick(["</body></html>", ""]), main))
    return out


class Model:
    def __init__(self, weights: np.ndarray, transitions: list[list[float]]):
        self.weights, self.transitions = weights, transitions


def train() -> Model:
    rows, lengths, tags = [], [], []
    for page, main in labelled():
        found, want = blocks(page), [" ".join(m.split()) for m in main]
        if not found:
            continue
        at = 0
        for b in found:
            hit = at < len(want) and b.text == want[at]
            at += hit
            tags.append(int(hit))
            rows.append(hashed(b.path + shape_features(b.shape)))
        lengths.append(len(found))
    width = max(map(len, rows))
    feats = np.zeros((len(rows), width), np.int64)  # 0: nothing; its weight is set to 0 in the end
    for i, x in enumerate(rows):
        feats[i, : len(x)] = x
    weights, transitions = trained(feats, np.array(lengths), np.array(tags), HASHED, epochs=10, batch=50)
    fill = weights[0]
    weights[0] = 0.0
    bias = hashed(["bias"])[0]
    weights[bias] += fill * (width - np.mean([len(x) for x in rows]))
    return Model(weights, transitions.tolist())


def extractor(model: Model):
    """A function from whole html to its main text; it remembers the weights of features and shapes between calls."""
    known: dict[str, int] = {}
    shapes: dict[tuple, float] = {}

    def says(feature: str) -> int:
        w = known.get(feature)
        if w is None:
            if len(known) > REMEMBERED:
                known.clear()
            w = known[feature] = round(float(model.weights[hashed([feature])[0]]) * UNIT)
        return w

    def of_shape(shape: tuple) -> float:
        if shape not in shapes:
            if len(shapes) > REMEMBERED:
                shapes.clear()
            shapes[shape] = float(model.weights[hashed(shape_features(shape))].sum())
        return shapes[shape]

    def extract(page: str | None) -> str:
        found = blocks(page or "", says)
        emission = [b.path / UNIT + of_shape(b.shape) for b in found]
        return " ".join(b.text for b, tag in zip(found, viterbi(emission, model.transitions)) if tag)

    return extract


def main_text(pages: DataFrame, *, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    shared = pages.sparkSession.sparkContext.broadcast(train())

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extract = extractor(shared.value)
        for b in batches:
            yield pd.Series([extract(x) for x in b], dtype=object)

    out = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), text(text_of(pages, html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
