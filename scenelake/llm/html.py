"""HTML main-text extraction by a linear-chain conditional random field.

A page is cut into leaf blocks: runs of text between block-level boundaries,
each with the tags, classes and ids of its ancestors. A linear-chain CRF labels
the blocks of a page as main text or not; Viterbi gives the best sequence. It
is trained on labelled pages that :func:`labelled_pages` lays out in many forms
from seeds, by AdaGrad on the exact conditional likelihood.

Rules of the text: character references are decoded, white space inside a block
becomes one space, blocks are trimmed and joined in page order by two line
feeds; script, style, template and the like, comments and markup are no text.

Defined results:
- null, empty and text-free pages give the empty text;
- markup that breaks off inside a tag, comment, script, template or svg ends the page there; other bad markup is
  read on as the HTML parsing rules do: ``</`` and no letter is a comment up to ``>``, ``<!-->`` is an empty one,
  ``--!>`` ends one, a stray quote is part of its attribute, a title has no markup, templates and objects nest,
  an svg is empty if self-closing and ends where an HTML tag such as ``p`` stands in it, and an audio, video or
  canvas ends with what it stands in. A quote that nothing closes does not hold the tag open, and an audio, video,
  canvas or object that nothing ends holds nothing;
- white space is what Python's ``str.split`` takes for it, no-break spaces and U+001C to U+001F included;
- elements nested deeper than ``DEPTH`` stand beside the deepest, as in browsers, so a page takes linear time;
- repeated rows are extracted each for itself, an empty table gives no rows;
- further columns are not read, whatever their names.
"""

from __future__ import annotations

import html as references
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_text

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that run to their own end tag, whatever stands in them.
_RAW = frozenset("script style noscript iframe textarea xmp noembed noframes".split())
#: Elements of markup that is no text. The end tags of outer elements end the last four, but not the first two.
_CLOSED = frozenset(["template", "object"])
_HIDDEN = _CLOSED | {"svg", "canvas", "audio", "video"}
#: Start tags that end an open svg, and elements in which it holds HTML.
_BREAK = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_POINTS = ("foreignobject", "desc", "title")
#: Start tags that end an open element of the named kinds.
_ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
    "body": {"head"},
}
_value = r"""(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+|(?=>))"""
_attribute = rf"[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_value})?+"
_token = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:\s++|/(?!>)|{_attribute})*+)(/?)>"
    r"|<(?:[!?]|/(?![a-zA-Z]))[^>]*>|([^<]+)|<",
    re.S,
)
_names = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I | re.S)
_parts = re.compile(r"[a-zA-Z]+")
_hidden = re.compile(rf"<(?:{'|'.join(sorted(_HIDDEN))})[\s/>]", re.I)
_end_of = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in [*_RAW, "title"]}


#: Elements that may be open at once; deeper ones stand beside the deepest.
DEPTH = 512


class Block:
    """A leaf block: its text, its ancestors' features, and the characters inside links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


def _marks(attributes: str) -> tuple[str, ...]:
    found = []
    for _, a, b, c in _names.findall(attributes):
        found += [w.lower() for w in _parts.findall(a or b or c)]
    return tuple(found)


def _hidden_ends(source: str) -> dict[int, int]:
    """Where to read on behind each element of ``_HIDDEN`` that ends, by the place of its start tag.

    One pass over the page with the open elements, so nested and unclosed ones take linear time.
    """
    ends: dict[int, int] = {}
    if not _hidden.search(source):
        return ends
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}
    floors = [0]  # elements below are out of the reach of end tags
    titled = True

    def close(i: int, own: int, others: int) -> None:
        while len(stack) > i:
            name, start = stack.pop()
            places[name].pop()
            if name in _HIDDEN:
                ends[start] = own if len(stack) == i else others
        while floors[-1] > i:
            floors.pop()

    def last(name: str) -> int:
        return places[name][-1] if places.get(name) else -1

    def foreign() -> bool:
        return last("svg") > max(map(last, _POINTS))

    at, end = 0, len(source)
    while at < end:
        found = _token.match(source, at)
        start, at = at, found.end()
        closing, name, _, empty, text = found.group(1, 2, 3, 4, 5)
        if text is not None:
            continue
        if name is None:
            rest = source[start + 1 : start + 2]
            if at == start + 1 and (rest.isascii() and rest.isalpha() or rest == "/"):
                break
            continue
        name = name.lower()
        if closing:
            i = last(name)
            if i >= floors[-1] - (name in _CLOSED and i == floors[-1] - 1) and i >= 0:
                close(i, at, start)
            continue
        if name in _BREAK:
            while foreign():
                close(last("svg"), start, start)
        inside = foreign()
        if name in _VOID or (inside or name == "svg") and empty:
            continue
        if not inside and name in _end_of and (titled or name != "title"):
            over = _end_of[name].search(source, at)
            titled = titled and (over is not None or name != "title")
            if over or name != "title":
                at = over.end() if over else end
                continue
        if not inside and name not in _INLINE and name not in _HIDDEN and stack and stack[-1][0] == "p":
            close(len(stack) - 1, start, start)
        places.setdefault(name, []).append(len(stack))
        stack.append((name, start))
        if name in _CLOSED and not inside:
            floors.append(len(stack))
    return ends


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tuple(stack), linked))
            parts.clear()
        linked = 0

    source, at, end = html or "", 0, len(html or "")
    links = 0
    hidden = _hidden_ends(source)
    titled = True  # whether a title may still end
    while at < end:
        found = _token.match(source, at)
        start, at = at, found.end()
        closing, name, attributes, empty, text = found.group(1, 2, 3, 4, 5)
        if text is not None:
            text = references.unescape(text)
            parts.append(text)
            if links:
                linked += len(text)
            continue
        if name is None:
            if at > start + 1 or source.startswith("<!", start) or source.startswith("<?", start):
                continue
            rest = source[start + 1 : start + 2]
            if rest.isascii() and rest.isalpha() or rest == "/":
                break  # a tag that never ends
            parts.append("<")
            continue
        name = name.lower()
        if closing:
            if name == "a":
                links = max(0, links - 1)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name not in _INLINE or any(t not in _INLINE for t, _ in stack[i:]):
                        flush()
                    del stack[i:]
                    break
            else:
                if name not in _INLINE:
                    flush()
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            continue
        if name in _HIDDEN:
            if not (name == "svg" and empty):
                at = hidden.get(start, end if name in ("svg", "template") else at)
            continue
        if name in _RAW:
            close = _end_of[name].search(source, at)
            at = close.end() if close else end
            continue
        if name == "title" and titled:
            close = _end_of[name].search(source, at)
            titled = close is not None
            if titled:
                flush()
                stack.append((name, _marks(attributes) if attributes else ()))
                parts.append(references.unescape(source[at : close.start()]))
                flush()
                stack.pop()
                at = close.end()
                continue
        if name not in _INLINE:
            flush()
            # A block-level start ends an open paragraph and the inline elements in it.
            for i in range(len(stack) - 1, -1, -1):
                tag = stack[i][0]
                if tag == "p" or tag in _ENDS.get(name, ()):
                    del stack[i:]
                    links = sum(t == "a" for t, _ in stack)
                elif tag not in _INLINE:
                    break
        if len(stack) >= DEPTH:  # as browsers do, a sibling of the deepest element
            links -= stack.pop()[0] == "a"
        if name == "a":
            links += 1
        stack.append((name, _marks(attributes) if attributes else ()))
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """The feature names of each block of a page."""
    out = []
    n = len(found)
    path, own, above = None, "none", frozenset()
    for i, block in enumerate(found):
        text = block.text
        words = text.count(" ") + 1
        share = min(3, int(4 * min(1.0, block.linked / len(text))))
        if block.path != path:
            path = block.path
            own = next((t for t, _ in reversed(path) if t not in _INLINE), "none")
            tags, classes = {t for t, _ in path if t not in _INLINE}, {marks for t, marks in path if marks and t not in ("html", "body")}
            above = frozenset([f"a:{t}" for t in tags] + [f"c:{m}" for marks in classes for m in marks])
        names = above | {
            f"t:{own}",
            f"w:{min(7, words.bit_length())}",
            f"l:{share}",
            f"e:{text[-1] in '.!?:;\"'}",
            f"s:{min(3, sum(map(text.count, '.,;')).bit_length())}",
            f"m:{text[0] in '©®™' or '©' in text}",
            f"p:{min(3, 4 * i // n)}",
            "bias",
        }
        out.append(sorted(names))
    return out


class ChainCRF:
    """Two labels (0: other, 1: main) along a page."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, 2))
        self.step = np.zeros((2, 2))
        self.rows: dict[str, tuple[float, float]] = {}

    def _emissions(self, page: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[f].sum(0) for f in page])

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.3, ridge: float = 2e-4) -> None:
        """AdaGrad on the negative conditional log-likelihood."""
        for names in (n for page, _ in pages for block in page for n in block):
            self.index.setdefault(names, len(self.index))
        data = [([[self.index[n] for n in block] for block in page], labels) for page, labels in pages if page]
        self.weights = np.zeros((len(self.index), 2))
        g_weights, g_step = np.full(self.weights.shape, 1e-2), np.full((2, 2), 1e-2)
        rng = random.Random(3)
        for _ in range(epochs):
            rng.shuffle(data)
            for page, labels in data:
                d_emit, d_step = self._slopes(page, labels)
                flat = [f for block in page for f in block]
                d = np.repeat(d_emit, [len(b) for b in page], axis=0)
                touched, place = np.unique(flat, return_inverse=True)
                g = np.stack([np.bincount(place, d[:, k], touched.size) for k in (0, 1)], 1)
                g += ridge * self.weights[touched]
                g_weights[touched] += g * g
                self.weights[touched] -= rate * g / np.sqrt(g_weights[touched])
                g_step += d_step * d_step
                self.step -= rate * d_step / np.sqrt(g_step)
        self.rows = {n: tuple(self.weights[i].tolist()) for n, i in self.index.items()}

    def _slopes(self, page: list[list[int]], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The marginals of labels and of steps less those of the given labels, by the forward-backward recursions."""
        emit = self._emissions(page)
        n = len(page)
        forward, back = np.empty((n, 2)), np.zeros((n, 2))
        forward[0] = emit[0]
        for i in range(1, n):
            forward[i] = emit[i] + np.logaddexp(*(forward[i - 1][:, None] + self.step))
        for i in range(n - 2, -1, -1):
            back[i] = np.logaddexp(*(self.step + emit[i + 1] + back[i + 1]).T)
        total = np.logaddexp(*forward[-1])
        d_emit = np.exp(forward + back - total)
        d_step = np.zeros((2, 2))
        if n > 1:
            joint = forward[:-1, :, None] + self.step + (emit + back)[1:, None, :] - total
            d_step = np.exp(joint).sum(0)
            np.subtract.at(d_step, (labels[:-1], labels[1:]), 1)
        d_emit[np.arange(n), labels] -= 1
        return d_emit, d_step

    def gradient(self, page: list[list[int]], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The gradient of the negative log-likelihood of one page, in the weights and in the steps."""
        d_emit, d_step = self._slopes(page, labels)
        d_weights = np.zeros_like(self.weights)
        for i, block in enumerate(page):
            np.add.at(d_weights, block, d_emit[i])
        return d_weights, d_step

    def decode(self, page: list[list[str]]) -> list[int]:
        """The best label sequence, by Viterbi; a tie goes to label 0."""
        if not page:
            return []
        rows, none = self.rows, (0.0, 0.0)
        (s00, s01), (s10, s11) = self.step.tolist()
        links: list[tuple[int, int]] = []
        v0 = v1 = 0.0
        for i, names in enumerate(page):
            e0 = e1 = 0.0
            for name in names:
                a, b = rows.get(name, none)
                e0 += a
                e1 += b
            if i:
                from0, from1 = (0 if v0 + s00 >= v1 + s10 else 1), (0 if v0 + s01 >= v1 + s11 else 1)
                links.append((from0, from1))
                v0, v1 = max(v0 + s00, v1 + s10) + e0, max(v0 + s01, v1 + s11) + e1
            else:
                v0, v1 = e0, e1
        label = int(v1 > v0)
        out = [label]
        for link in reversed(links):
            label = link[label]
            out.append(label)
        return out[::-1]


# Names that pages give to their parts.
_MAIN = "content article post entry story main body text page prose single".split()
_MENU = "nav menu navbar navigation breadcrumb breadcrumbs topnav tabs toc pagination pager skip".split()
_HEAD = "header masthead banner branding top logo site title hero".split()
_FOOT = "footer foot bottom colophon copyright legal credits".split()
_SIDE = "sidebar aside side widget related recommended trending popular more rail".split()
_NOTE = "notice cookie consent gdpr alert modal popup overlay warning subscribe newsletter paywall".split()
_ADS = "ad ads advert advertisement adsense sponsored sponsor promo promotion banner".split()
_FORM = "form search login signup subscribe newsletter contact".split()
_SHARE = "share social sharing tags follow buttons tools meta".split()
_TALK = "comments comment replies reply respond discussion disqus thread responses feedback user reviews review opinions talk".split()
_WRAP = "page site wrapper container content layout app root outer row col grid wrap inner".split()
_BYLINE = "meta byline author date time published posted info details".split()


def labelled_pages(n: int = 400, seed: int = 17) -> list[tuple[str, list[int]]]:
    """Pages in many layouts, and the label of each of their blocks, in order."""
    rng = random.Random(seed)
    sounds = "ba de fi go lu mer tan sol rin che ver ung ión eau ß th wh ck é ñ ö".split()

    def word() -> str:
        return "".join(rng.choice(sounds) for _ in range(rng.randint(1, 4)))

    def phrase(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize()

    def sentences(low: int, high: int) -> str:
        return " ".join(phrase(1, 16) + rng.choice("....!?") for _ in range(rng.randint(low, high)))

    def attr(names: list[str]) -> str:
        name = rng.choice(names)
        other = rng.choice(["", "", f" {word()}", f"-{word()}", f" {rng.choice(['box', 'wrap', 'inner', 'block'])}"])
        return f' {rng.choice(["class", "class", "id"])}="{name}{other}"'

    def page() -> tuple[str, list[int]]:
        out: list[str] = []
        labels: list[int] = []

        def put(label: int, html: str, blocks_in: int = 1) -> None:
            out.append(html)
            labels.extend([label] * blocks_in)

        def links(names: list[str], tag: str, some: int) -> None:
            k = rng.randint(2, 8)
            named = attr(names) if rng.random() < 0.7 or tag == "div" else ""
            if rng.random() < 0.7:
                put(0, f"<{tag}{named}><ul>" + "".join(f'<li><a href="/">{phrase(1, some)}</a></li>' for _ in range(k)) + f"</ul></{tag}>", k)
            else:
                put(0, f"<{tag}{named}>" + " | ".join(f'<a href="/">{phrase(1, some)}</a>' for _ in range(k)) + f"</{tag}>")

        def bit(names: list[str], tags: list[str], inner: str = "") -> None:
            tag = rng.choice(tags)
            named = attr(names) if tag in ("div", "section", "p") or rng.random() < 0.5 else ""
            text = inner or rng.choice([phrase(1, 12), sentences(1, 3), sentences(1, 5)])
            put(0, f"<{tag}{named}>{text}</{tag}>" if tag == "p" or rng.random() < 0.4 else f"<{tag}{named}><p>{text}</p></{tag}>")

        def byline() -> None:
            tag = rng.choice(["div", "p", "span", "footer"])
            text = rng.choice([f"By <a href=/>{phrase(1, 2)}</a>", phrase(1, 5), f"<time>{phrase(1, 3)}</time>", f'{phrase(1, 2)} <a href="/">{phrase(1, 2)}</a>'])
            put(0, f"<{'div' if tag == 'span' else tag}{attr(_BYLINE)}>{text}</{'div' if tag == 'span' else tag}>")

        def main_text() -> None:
            if rng.random() < 0.85:
                title = f"<h1{attr(['title', 'headline', 'entry', 'post']) if rng.random() < 0.4 else ''}>{rng.choice([phrase(1, 12), sentences(1, 3)])}</h1>"
                if opened.startswith(("<article", "<main")) and rng.random() < 0.35:
                    out.append(f"<header{attr(['entry', 'post', 'article', 'header', 'title']) if rng.random() < 0.6 else ''}>")
                    put(1, title)
                    if rng.random() < 0.5:
                        byline()
                    out.append("</header>")
                else:
                    put(1, title)
                    if rng.random() < 0.25:
                        byline()
            body = f"<div{attr(_MAIN)}>" if rng.random() < 0.3 else ""
            out.append(body)
            if rng.random() < 0.05:
                links(_MENU, "nav", 4)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 14])):
                kind = rng.random()
                if kind < 0.62:
                    put(1, f"<p>{rng.choice([phrase(1, 3), sentences(1, 2), sentences(1, 9)])}</p>")
                elif kind < 0.72:
                    put(1, f"<p><b>{sentences(1, 6)}<br>")
                elif kind < 0.80:
                    put(1, f"<{(h := rng.choice(['h2', 'h3']))}>{phrase(1, 8)}</{h}>")
                elif kind < 0.86:
                    k = rng.randint(1, 5)
                    put(1, "<ul>" + "".join(f"<li>{sentences(1, 2)}</li>" for _ in range(k)) + "</ul>", k)
                elif kind < 0.90:
                    put(1, f"<blockquote><p>{sentences(1, 4)}</p></blockquote>")
                elif kind < 0.94:
                    put(1, f"<pre>{phrase(2, 20)}</pre>")
                elif kind < 0.955:
                    put(1, f"<figure><img src=x><figcaption>{phrase(2, 12)}</figcaption></figure>")
                elif kind < 0.965:
                    k = rng.randint(2, 5)
                    put(1, "<ul>" + "".join(f'<li><a href="/">{phrase(1, 6)}</a>{rng.choice(["", " " + phrase(1, 6)])}</li>' for _ in range(k)) + "</ul>", k)
                elif kind < 0.98:
                    k = rng.randint(2, 6)
                    put(1, "<table><tr>" + "".join(f"<td>{phrase(1, 4)}</td>" for _ in range(k)) + "</tr></table>", k)
                else:
                    put(1, f'<p>{sentences(1, 3)} <a href="/">{phrase(1, 4)}</a> {sentences(1, 2)}</p>')
                if rng.random() < 0.06:
                    bit(_ADS, ["div", "aside"])
                if rng.random() < 0.03:
                    links(_SIDE + _SHARE, "div", 6)
                if rng.random() < 0.02:
                    bit(_NOTE, ["div", "aside"])
            if rng.random() < 0.15:
                links(_SHARE, rng.choice(["div", "footer"]), 3)
            if body:
                out.append("</div>")

        def talk() -> None:
            outer = rng.choice(["section", "div", "ol"])
            out.append(f"<{outer}{attr(_TALK)}>")
            if rng.random() < 0.6:
                h = rng.choice(["h2", "h3", "h4"])
                put(0, f"<{h}>{phrase(1, 4)}</{h}>")
            for _ in range(rng.randint(1, 5)):
                tag = rng.choice(["div", "article", "li"])
                named = attr(_TALK) if rng.random() < 0.6 else ""
                put(0, f"<{tag}{named}><p>{sentences(1, 6)}</p></{tag}>")
            out.append(f"</{outer}>")

        out.append("<!DOCTYPE html><html><head>")
        put(0, f"<title>{phrase(1, 10)}</title><style>p{{}}</style></head>")
        out.append(f"<body{attr(_MAIN + ['home', 'post']) if rng.random() < 0.2 else ''}>")
        for _ in range(rng.choice([0, 0, 1, 2])):  # never closed, which changes no block
            out.append(f"<div{attr(_WRAP)}>")
        if rng.random() < 0.4:
            tag = rng.choice(["header", "div"])
            out.append(f"<{tag}{attr(_HEAD) if tag == 'div' else ''}>")
            put(0, rng.choice([f"<h1>{phrase(1, 4)}</h1>", f"<p>{phrase(1, 6)}</p>", f"<div>{phrase(1, 6)}</div>"]))
            out.append(f"</{tag}>")
        if rng.random() < 0.85:
            tag = rng.choice(["nav", "nav", "div", "ul"])
            if tag == "ul":
                k = rng.randint(2, 7)
                put(0, f"<ul{attr(_MENU)}>" + "".join(f'<li><a href="/">{phrase(1, 3)}</a></li>' for _ in range(k)) + "</ul>", k)
            else:
                links(_MENU, tag, 3)
        for names, chance, tags in ((_NOTE, 0.3, ["div", "section", "aside"]), (_ADS, 0.55, ["div", "aside"])):
            if rng.random() < chance:
                bit(names, tags)
        if rng.random() < 0.2:
            put(0, f"<form{attr(_FORM)}><label>{phrase(1, 4)}</label><input type=text><button>{phrase(1, 2)}</button></form>", 2)
        side_first = rng.random() < 0.15
        if side_first:
            bit(_SIDE, ["aside", "div"])
        opened, closed = rng.choice(
            [
                ("<article>", "</article>"),
                ("<article>", "</article>"),
                ("<main><article>", "</article></main>"),
                ("<main>", "</main>"),
                (f"<div{attr(_MAIN)}>", "</div>"),
                (f"<div{attr(_MAIN)}><div{attr(_MAIN)}>", "</div></div>"),
                (f"<section{attr(_MAIN)}>", "</section>"),
                (f"<article{attr(_MAIN)}>", "</article>"),
                ('<div role="main">', "</div>"),
                ("<div><div>", "</div></div>"),
            ]
        )
        out.append(opened)
        main_text()
        inside = rng.random() < 0.45
        if inside and rng.random() < 0.7:
            talk()
        if inside and rng.random() < 0.3:
            bit(_NOTE + _ADS, ["div", "aside"])
        out.append(closed)
        if not inside and rng.random() < 0.4:
            talk()
        if rng.random() < 0.2:
            put(0, f"<form{attr(_FORM)}><p>{phrase(1, 6)}</p><textarea>x</textarea></form>")
        if rng.random() < 0.35:
            rng.choice([lambda: links(_SIDE, "aside", 8), lambda: bit(_SIDE, ["aside", "div"])])()
        if rng.random() < 0.85:
            text = rng.choice(["&copy; ", "", "Copyright "]) + rng.choice([phrase(1, 8), sentences(1, 3)])
            bit(_FOOT, ["footer", "footer", "div"], text)
        if rng.random() < 0.9:
            out.append("</body></html>")
        return "".join(out), labels

    return [page() for _ in range(n)]


@lru_cache(maxsize=1)
def trained() -> ChainCRF:
    """The CRF, trained on the labelled pages."""
    pages = []
    for html, labels in labelled_pages():
        found = features(blocks(html))
        if len(found) != len(labels):
            raise ValueError("a labelled page does not parse into its blocks")
        pages.append((found, labels))
    crf = ChainCRF()
    crf.fit(pages)
    return crf


def main_text(crf: ChainCRF, html: str | None) -> str:
    """The main text of one page."""
    found = blocks(html)
    return "\n\n".join(b.text for b, label in zip(found, crf.decode(features(found))) if label)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html", crf: ChainCRF | None = None) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars``, a row for each input row."""
    shared = pages.sparkSession.sparkContext.broadcast(crf or trained())

    def start():
        model = shared.value

        def work(htmls: list) -> list[pa.Array]:
            texts = [main_text(model, html) for html in htmls]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    return map_text(pages, keep, html_col, "text string, n_chars long", start)


def op9_html(spark, sf_dir: str) -> DataFrame:
    """Contract query: the main text of every whole page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
