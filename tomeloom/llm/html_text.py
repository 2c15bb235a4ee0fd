"""Main text of web pages by the maximum-scoring run of tokens.

A page is read as a run of tags and words.  Words score above zero and tags
below, each by its context, with weights that are log-odds over labelled pages;
one linear scan finds the contiguous run of the greatest sum.  Text of that run
is given out by blocks; elements within it that never hold main text (scripts,
forms, menus, adverts, notices, reader comments) are passed over.

What an element is follows from its tag, from whether it is hidden, and from the
words of its class and id.  Names are evidence, not a verdict: an element with
the name of a side part still counts as an ordinary one if it holds the page's
``main`` or ``h1``; one whose name is doubtful (a notice, a widget, legal terms)
also if it holds more running text than all that is outside such elements.
Names of states ("has-sidebar", "comments-open", "overflow-hidden") say nothing.

Defined cases: null, empty and text-free pages give an empty text; markup that
never ends is read to the end of the page; unknown character references stay as
they are; rows without an id are kept with a null id; repeated rows are each
extracted; very long pages and deeply nested ones take time in proportion to
their length; other columns are ignored, and columns to keep may have any name
but the two that are added.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import table

# Element names by their part on a page.
RAW = frozenset("script style noscript template iframe svg math canvas object textarea title".split())
CHROME = frozenset("head nav aside footer form button select dialog menu label fieldset option menuitem audio video map".split())
BODY = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {"p": frozenset("p div article section ul ol table h1 h2 h3 h4 h5 h6 blockquote pre footer header nav aside form main".split()), "li": frozenset({"li"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"})}
SIDE_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar cookie cookies cookiebar consent gdpr comment comments commentlist disqus respond replies reply social share sharing newsletter subscribe signup login search popup modal pager pagination skiplink toolbar".split())
DOUBTFUL_NAMES = frozenset("promo promotion banner notice notification alert related recommended recommendations widget widgets overlay copyright legal tags hidden sr".split())
STATES = frozenset("has have with no non without open opened closed off on enabled disabled is not overflow visible".split())
COMPOUND_NAMES = frozenset({("site", "header"), ("page", "header"), ("top", "bar"), ("side", "bar"), ("bread", "crumbs"), ("sign", "up"), ("log", "in"), ("pop", "up"), ("skip", "link")})
BODY_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|post-?body|post-?content|entry-?content|story\w*|main-?content|content-?body|article-?body|body-?text|prose)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


@dataclass
class Token:
    kind: str  # the feature that its weight is looked up by
    text: str | None  # None for a tag
    block: int
    context: str  # plain, body, side, or inner: a side part within a body, which breaks no run
    words: int = 0
    named: int = 0  # number of the outermost element around with a side part's name, or 0


@dataclass
class _Block:
    """An open block element and the inline elements open in it."""

    name: str
    context: str
    named: int
    inline: list[str] = field(default_factory=list)
    n_inline: Counter = field(default_factory=Counter)


def _named_part(names: str) -> bool | None:
    """True if a class or id names a side part, False if it may be one, None if it names none."""
    doubt = None
    for name in names.lower().split():
        parts = [x for x in _PARTS.split(name) if x]
        if STATES.intersection(parts):
            continue
        if SIDE_NAMES.intersection(parts) or COMPOUND_NAMES.intersection(zip(parts, parts[1:], strict=False)):
            return True
        if DOUBTFUL_NAMES.intersection(parts):
            doubt = False
    return doubt


def _attributes(text: str) -> tuple[str, bool]:
    """Class, id, role and label of an element, and whether it is hidden."""
    names, hidden = [], False
    for m in _ATTRIBUTE.finditer(text):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role", "aria-label"):
            names.append(value)
        elif key == "hidden" and value.lower() != "false" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _NO_DISPLAY.search(value):
            hidden = True
    return " ".join(names), hidden


def tokenize(page: str) -> list[Token]:
    """Tags and texts of a page with the context of each, in time that grows with its length."""
    out: list[Token] = []
    stack = [_Block("", "plain", 0)]
    open_blocks: Counter = Counter()
    sure: list[bool] = [True]  # of each named element: whether its name is beyond doubt
    main: set[int] = set()  # named elements that hold the page's main or h1
    block, at, n, n_links = 0, 0, len(page), 0

    def close() -> None:
        nonlocal n_links
        top = stack.pop()
        open_blocks[top.name] -= 1
        n_links -= top.n_inline["a"]

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name, top = m[2], stack[-1]
        if name is None:
            text = m[0]
            if text[0] == "<" and len(text) > 1:
                if not text.startswith("<![CDATA["):
                    continue
                text = text[9:].removesuffix("]]>")
            text = html_lib.unescape(text)
            inside = top.name
            leaf = "link" if n_links else "para" if open_blocks["p"] or inside in ("blockquote", "pre") else "head" if inside[:1] == "h" and inside[1:].isdigit() else "item" if inside in ("li", "td", "th", "dd", "dt") else "bare"
            out.append(Token(leaf, text, block, top.context, len(text.split()), top.named))
            continue
        name = name.lower()
        attrs = m[3] or ""
        if m[1]:
            if name in INLINE:
                if top.n_inline[name]:  # a stray end tag of an inline element closes no block around it
                    while True:
                        last = top.inline.pop()
                        top.n_inline[last] -= 1
                        n_links -= last == "a"
                        if last == name:
                            break
            else:
                if open_blocks[name]:
                    while stack[-1].name != name:
                        close()
                    close()
                block += 1
            if name == "br" or name == "p" and not open_blocks["p"]:
                block += 1
            out.append(Token(f"/{name}", None, block, top.context, 0, top.named))
            continue
        while len(stack) > 1 and name in CLOSED_BY.get(stack[-1].name, ()):
            close()
        top = stack[-1]
        if name not in INLINE:
            block += 1
        if name in VOID or attrs.endswith("/") and name not in RAW:
            out.append(Token(name, None, block, top.context, 0, top.named))
            continue
        names, hidden = _attributes(attrs) if attrs else ("", False)
        context, named = top.context, top.named
        if context not in ("side", "inner"):
            part = _named_part(names) if names and name not in ("html", "body") else None
            if name in CHROME or hidden or name == "header" and context != "body":
                context = "inner" if context == "body" else "side"
            elif part is not None and name != "main" and not named:
                sure.append(part)
                named = len(sure) - 1
            elif name in BODY or names and BODY_NAMES.search(names):
                context = "body"
        if name in ("main", "h1") and named:
            main.add(named)
        out.append(Token(name, None, block, context, 0, named))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif name in INLINE:
            if context == top.context and named == top.named:
                top.inline.append(name)
                top.n_inline[name] += 1
                n_links += name == "a"
            else:  # a hidden or named inline element is a part of its own
                stack.append(_Block(name, context, named))
                open_blocks[name] += 1
        else:
            stack.append(_Block(name, context, named))
            open_blocks[name] += 1
    return _placed(out, sure, main)


def _placed(tokens: list[Token], sure: list[bool], main: set[int]) -> list[Token]:
    """The tokens with the contexts of named elements settled."""
    prose: Counter = Counter()
    for t in tokens:
        if t.text is not None and t.context in ("plain", "body") and t.kind in ("para", "head", "bare"):
            prose[t.named] += t.words
    side = {no for no in range(1, len(sure)) if no not in main and (sure[no] or prose[no] <= prose[0])}
    for t in tokens:
        if t.named in side:
            t.context = "inner" if t.context in ("body", "inner") else "side"
        t.kind = f"word {t.context} {t.kind}" if t.text is not None else f"{t.kind} {t.context}"
    return tokens


def labelled_pages() -> list[str]:
    """Pages with their main element marked by <!--main--> and <!--/main-->, built from layouts and lengths.

    The marks are comments, so they never change how a page is read.
    """
    sentence = "Words of running prose follow one another until the sentence comes to its end."
    paras = lambda k, n, tag="p": "".join(f"<{tag}>{' '.join([sentence] * n)}</{tag}>" for _ in range(k))
    links = lambda k: "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(k))
    pages = []
    for k in (1, 2, 4, 8, 16):
        for n in (1, 3, 6):
            main = f"<h1>A heading of the page</h1>{paras(k, n)}"
            nav, foot = f"<nav><ul>{links(5)}</ul></nav>", "<footer>&copy; the site and its owner, all rights</footer>"
            ad = f'<div class="ad">{sentence} Buy one now.</div>'
            side = f'<aside><h3>Most read</h3><ul>{links(8)}</ul></aside>'
            talk = f'<div class="comments"><h3>Comments</h3><div class="comment"><p>{sentence}</p></div></div>'
            head = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>"
            pages += [
                f"{head}{nav}{ad}<!--main--><article>{main}</article><!--/main-->{foot}</body></html>",
                f'{head}<header><a href="/">Site</a>{nav}</header><!--main--><main>{main}</main><!--/main-->{side}{talk}{foot}</body></html>',
                f'{head}<div id="menu"><ul>{links(6)}</ul></div>{side}<!--main--><div class="content-body">{main}</div><!--/main-->{talk}{ad}{foot}</body></html>',
                f"{head}<div><a href='/'>Home</a> <a href='/n'>News</a></div><!--main--><div>{main}</div><!--/main--><div><a href='/p'>Previous</a> <a href='/q'>Next</a></div>{foot}</body></html>",
                f"{head}{nav}<!--main--><div><h2>A heading</h2>{paras(k, n, 'div')}</div><!--/main--><form><label>Name</label><input><button>Send</button></form>{foot}</body></html>",
            ]
    return pages


def fit_weights(pages: list[str], smooth: float = 1.0) -> dict[str, float]:
    """Log-odds of each token kind within and without the marked run; words end up above 0 where prose is, tags below."""
    inside, outside = Counter(), Counter()
    for page in pages:
        lo, hi = page.index("<!--main-->"), page.index("<!--/main-->")
        for part, count in ((page[:lo], outside), (page[lo:hi], inside), (page[hi:], outside)):
            for t in tokenize(part):  # in these layouts no context reaches over a mark
                count[t.kind] += max(t.words, 1) if t.text is not None else 1
    n1, n0 = sum(inside.values()), sum(outside.values())
    weights = {}
    for kind in inside.keys() | outside.keys():
        odds = math.log((inside[kind] + smooth) / (n1 + smooth)) - math.log((outside[kind] + smooth) / (n0 + smooth))
        if not kind.startswith("word") or "side" in kind:
            weights[kind] = min(odds, -0.5)
        else:
            weights[kind] = max(odds, -0.8 if kind.endswith("link") else 0.2)
    return weights


DEFAULT_WORD = {"side": -2.0, "body": 1.0, "plain": 0.6}
LINK_WORD = {"side": -2.0, "body": 0.3, "plain": -0.8}
DEFAULT_TAG = -0.5


def token_score(t: Token, weights: dict[str, float]) -> float:
    if t.context == "inner":
        return 0.0
    if t.text is None:
        w = weights.get(t.kind)
        return max(w, -3.0) if w is not None else DEFAULT_TAG
    if not t.words:
        return 0.0
    w = weights.get(t.kind)
    if w is None:
        _, context, leaf = t.kind.split()
        w = (LINK_WORD if leaf == "link" else DEFAULT_WORD)[context]
    return w * t.words


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of the greatest sum, the first and longest of equals; empty if none is above 0."""
    best, lo, hi, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best and best > 0 and start == lo:
            best, lo, hi = total, start, i + 1
    return lo, hi


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best run; if it reaches a marked main element, of that element's part of the run."""
    if not page:
        return ""
    tokens = tokenize(page)
    lo, hi = best_run([token_score(t, weights) for t in tokens])
    run = [t for t in tokens[lo:hi] if t.text is not None and t.context in ("plain", "body")]
    body = [t for t in run if t.context == "body"]
    return _blocks(body or run)


def _blocks(tokens: list[Token]) -> str:
    blocks: list[list[str]] = []
    at = None
    for t in tokens:
        if t.block != at:
            blocks.append([])
            at = t.block
        blocks[-1].append(t.text)
    return " ".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def extract_text(pages: DataFrame, weights: dict[str, float] | None = None, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the kept columns, text and n_chars of every page."""
    if {"text", "n_chars"} & {id_col, *keep}:
        raise ValueError("text and n_chars are the names of the columns that are added")
    weights = fit_weights(labelled_pages()) if weights is None else weights
    rows = pages.select(id_col, *keep, html_col)
    names = [id_col, *keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema) + ", text string, n_chars long"

    def run(parts):
        for batch in parts:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(p, weights) for p in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", F.col("text"), "n_chars")
