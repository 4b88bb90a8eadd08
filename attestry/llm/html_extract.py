"""Main text of web pages: a bidirectional LSTM (numpy) labels every text block of a page as content or boilerplate.

Blocks. The whole html is read tag by tag; text between block-level tags is one block, with the path of open elements.
Scripts, styles, comments and the like hold no text. A block's features are hashed tag-path elements (tags, class and id
words), hashed words, and a few measures (length, link share, place). The network reads a page's blocks in order in both
directions, so a block is labelled with the context of the whole page.

Training. The network is fitted here, on the driver, on SAMPLE pages at most (the least hashes of page_id; the bound is a
parameter, and so is how much of each the driver gets). A teacher labels their blocks by the semantic elements around them; besides the page itself, their blocks are
set anew into random layouts (below), so that the network learns class and id words, order and text, not one template.
A page in which the teacher finds no content is no example; if that is all of them, their longer unlinked blocks outside
named boilerplate are set into random layouts.
The seed is fixed: equal samples give equal networks.

Cases: a null or empty html, and one without content blocks, give an empty text; a tag that the page's end cuts is no
text, and one with an unclosed quote ends at its first >; elements without an end tag end with the page, and end tags
without an element are left out; a page takes time in proportion to its length, whatever it holds; unknown character references stay; rows that repeat are extracted alike; further columns are ignored; no
rows give no rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_DIMS, WORD_DIMS, MEASURES = 256, 32, 12
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
HIDDEN = 20
SAMPLE, LONGEST = 300, 1 << 16
EPOCHS = 8
#: Share of containers in training layouts whose class says nothing.
UNNAMED = 0.35
#: Training examples at least; few pages are set into more layouts each.
EXAMPLES = 2400

# Elements that part blocks, elements whose content is no text, and void elements.
PARTING = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul button iframe noscript label".split()
)
SILENT = set("script style head template noscript iframe canvas select textarea title".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the same kind, or of the named kinds, ends.
ENDS = {"p": PARTING, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
RAW = {"script": re.compile(r"</script(?=[\s/>])", re.I), "style": re.compile(r"</style(?=[\s/>])", re.I)}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What comes next in a tag: a value that begins with a quote, or the tag's end.
NEXT = re.compile(r"=\s*([\"'])|>")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT = re.compile(r"[^a-z]+")
#: Elements of a block's path that its features see, from either end; a deeper path loses those between.
ENDS_SEEN = 32
#: Elements that hold running text, not whole parts of a page.
RUNNING = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr td th figure figcaption caption hgroup address".split())
GROUPING = {"ul", "ol", "li", "table", "tr", "td", "th", "dl"}


def _words(text: str) -> list[str]:
    return [w for w in SPLIT.split(text.lower()) if w]


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends whose name ends at `at`: behind its first > outside quoted values, or at the page's end.

    A quote counts only where a value begins. One whose partner is missing, or isn't followed by what may follow a value,
    was never closed: its tag ends at the first > behind it. No quote is sought twice, so a page takes linear time.
    """
    n = len(page)
    while m := NEXT.search(page, at):
        if m[0] == ">":
            return m.end()
        close = page.find(m[1], m.end())
        if close < 0 or close + 1 < n and page[close + 1] not in " \t\n\r\f/>":
            return page.find(">", m.end()) + 1 or n
        at = close + 1
    return n


def _skipped(page: str, at: int) -> int:
    """The end of the comment, marked section or declaration that begins at `at`."""
    for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
        if page.startswith(opening, at):
            break
    end = page.find(closing, at + len(opening))
    return end + len(closing) if end >= 0 else len(page)


def blocks(page: str) -> list[tuple[str, tuple, float]]:
    """(text, path, link share) of each block with text, in page order. path: (tag, name words, whole names) from the root."""
    out: list[tuple[str, tuple, float]] = []
    path: list[str] = []  # the tags that are open
    parting: list[tuple[int, tuple]] = []  # those that part blocks: place in path, element
    opened: dict[str, list[int]] = defaultdict(list)  # the places of each tag in path
    silent = 0
    pieces: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                seen = parting if len(parting) <= 2 * ENDS_SEEN else parting[:ENDS_SEEN] + parting[-ENDS_SEEN:]
                out.append((text, tuple(x for _, x in seen), min(1.0, linked / len(text))))
            pieces.clear()
        linked = 0

    def pop(k: int) -> None:
        nonlocal silent
        for tag in path[k:]:
            silent -= tag in SILENT
            opened[tag].pop()
        del path[k:]
        while parting and parting[-1][0] >= k:
            parting.pop()

    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        m = None
        while begin >= 0 and not (m := TAG.match(page, begin)) and page[begin + 1 : begin + 2] not in ("!", "?"):
            begin = page.find("<", begin + 1)  # a lone < is text
        text = page[at : begin if begin >= 0 else n]
        if text and not silent:
            pieces.append(text)
            if opened["a"]:
                linked += len(text)
        if begin < 0:
            break
        if not m:
            at = _skipped(page, begin)
            continue
        at = _tag_end(page, m.end())
        tag = m[2].lower()
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in PARTING:
            close()
        if m[1]:
            if opened[tag]:
                pop(opened[tag][-1])
            continue
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = page.find(">", end.end()) + 1 or n if end else n
            continue
        if tag in PARTING:
            for k, (own, *_) in reversed(parting):
                if tag in ENDS.get(own, ()):
                    pop(k)
                    break
                if own not in ENDS:
                    break
        attributes = page[m.end() : at - 1]
        if tag in VOID or tag not in PARTING and attributes.endswith("/") and attributes[-2:-1] in ("", " ", "\"", "'"):  # not href=/
            continue
        if tag in PARTING:
            named = [x[0] or x[1] or x[2] for x in NAMES.findall(attributes)] if "=" in attributes else []
            parting.append((len(path), (tag, tuple(w for x in named for w in _words(x)), tuple(w for x in named for w in x.lower().split()))))
        opened[tag].append(len(path))
        path.append(tag)
        silent += tag in SILENT
    close()
    return out


@lru_cache(200_000)
def _place(word: str, dims: int) -> int:
    return zlib.crc32(word.encode()) % dims


@lru_cache(50_000)
def _path_features(path: tuple, known: frozenset) -> np.ndarray:
    out = np.zeros(PATH_DIMS, np.float32)
    for tag, names, *_ in path:
        if tag in ("html", "body"):
            continue
        out[_place("<" + tag, PATH_DIMS)] = 1
        for w in names:
            out[_place("." + w if w in known else "?", PATH_DIMS)] = 1
    if path:
        out[_place("=" + path[-1][0], PATH_DIMS)] += 0.5
    return out


def _container(path: tuple) -> tuple:
    """The path down to the last element that isn't part of running text; lists and cells with a name are parts of a page."""
    k = len(path)
    while k and path[k - 1][0] in RUNNING and not (path[k - 1][1] and path[k - 1][0] in GROUPING):
        k -= 1
    return path[:k]


def _common(a: tuple, b: tuple) -> float:
    """The share of a path that another one begins with."""
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    return k / max(1, len(a))


def features(found: list[tuple[str, tuple, float]], known: frozenset) -> np.ndarray:
    """A row for each block. known: the class and id words of the training pages and layouts; others are all one feature.

    Besides the path, the words and the block's own measures: how much of its path it shares with its neighbours, whether
    they stand in the same container, the share of the page's words that its container holds, and whether it stands outside
    the article or main element of a page that has one.
    """
    out = np.zeros((len(found), DIMS), np.float32)
    inside = [_container(path) for _, path, _ in found]
    held: dict[tuple, int] = defaultdict(int)
    for (text, _, _), c in zip(found, inside, strict=True):
        held[c] += text.count(" ") + 1
    whole = sum(held.values())
    semantic = [any(tag in TEACHER_CONTENT for tag, *_ in path) for _, path, _ in found]
    any_semantic = any(semantic)
    for k, (text, path, linked) in enumerate(found):
        row = out[k]
        row[:PATH_DIMS] = _path_features(path, known)
        words = text.split()
        hashed = np.bincount([_place(w, WORD_DIMS) for w in words], minlength=WORD_DIMS)
        row[PATH_DIMS : PATH_DIMS + WORD_DIMS] = hashed / len(words)
        before, after = found[k - 1][1] if k else (), found[k + 1][1] if k + 1 < len(found) else ()
        row[-MEASURES:] = (
            np.log1p(len(words)) / 5, linked, k / len(found), 1 / (k + 1), text[-1] in ".!?:;”\"", min(len(words), 10) / 10,
            _common(path, before), _common(path, after), k > 0 and inside[k] == inside[k - 1], k + 1 < len(found) and inside[k] == inside[k + 1], held[inside[k]] / whole, semantic[k] - any_semantic,
        )
    return out


class Network:
    """A bidirectional LSTM with one output a step; weights in one dictionary."""

    def __init__(self, weights: dict[str, np.ndarray], known: frozenset):
        self.w, self.known = weights, known

    @staticmethod
    def fresh(rng: np.random.Generator, known: frozenset) -> Network:
        w = {}
        for d in "fb":
            w["x" + d] = rng.normal(0, DIMS**-0.5, (DIMS, 4 * HIDDEN)).astype(np.float32)
            w["h" + d] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            w["c" + d] = np.zeros(4 * HIDDEN, np.float32)
            w["c" + d][HIDDEN : 2 * HIDDEN] = 1
        w["o"] = rng.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN).astype(np.float32)
        w["z"] = np.zeros(1, np.float32)
        return Network(w, known)

    @staticmethod
    def _sig(x):
        return 0.5 * (np.tanh(0.5 * x) + 1)

    def _forward(self, x: np.ndarray, mask: np.ndarray, d: str):
        """x: steps, pages, DIMS. Masked steps leave the state as it is, so padding at either end is harmless."""
        gates = x @ self.w["x" + d] + self.w["c" + d]
        steps, pages = mask.shape
        h = np.zeros((pages, HIDDEN), np.float32)
        c = np.zeros_like(h)
        kept = []
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = gates[t] + h @ self.w["h" + d]
            s = self._sig(a[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
            new = f * c + i * g
            tc = np.tanh(new)
            m = mask[t][:, None]
            kept.append((t, i, f, o, g, c, h, tc, m))
            c, h = m * new + (1 - m) * c, m * (o * tc) + (1 - m) * h
            out[t] = h
        return out, kept

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._forward(x, mask, d)[0] for d in "fb"], axis=2)
        return self._sig(both @ self.w["o"] + self.w["z"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over unmasked steps."""
        runs = {d: self._forward(x, mask, d) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        dz = (self._sig(both @ self.w["o"] + self.w["z"]) - y) * mask / mask.sum()
        out = {"o": np.einsum("tp,tph->h", dz, both), "z": dz.sum(keepdims=True).reshape(1)}
        dboth = dz[:, :, None] * self.w["o"]
        for k, d in enumerate("fb"):
            dh_out = dboth[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            da_all = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            dw = np.zeros_like(self.w["h" + d])
            dh = np.zeros((mask.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, i, f, o, g, c, h, tc, m in reversed(runs[d][1]):
                dh = dh + dh_out[t]
                dnew = m * dc + m * dh * o * (1 - tc * tc)
                da = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), m * dh * tc * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
                da_all[t] = da
                dw += h.T @ da
                dh, dc = da @ self.w["h" + d].T + (1 - m) * dh, dnew * f + (1 - m) * dc
            out["h" + d] = dw
            out["x" + d] = np.einsum("tpd,tpg->dg", x, da_all, optimize=True)
            out["c" + d] = da_all.sum(axis=(0, 1))
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), pages[0].shape[-1]), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = 1
    return x, mask


# The layouts of training pages, as element and class words.
CONTENT = ["article", "main", "div.content", "div.article-body", "div.post-content", "div.entry-content", "section.story", "div.main-text", "div.text", "div#content", "section.body", "td.content", "main.page", "div.blog-post", "div.post", "div.story", "div.article", "section.entry", "div.single", "div.prose", "div.rich-text", "article.post", "div#main", "div"]
LAYOUT = {
    "before": ["nav", "header", "div.nav", "ul.menu", "div.header", "div.navbar", "div.breadcrumbs", "div.masthead", "div.topbar", "header.site-header", "nav.main-nav", "div.skip-links", "div.search"],
    "notice": ["div.cookie-notice", "div.notice", "div.banner", "div.alert", "div.consent", "section.announcement", "div.cookies", "div.popup", "div.gdpr", "div.modal"],
    "advert": ["div.ad", "div.ads", "aside.advert", "div.sponsored", "div.promo", "div.advertisement", "section.sponsor", "ins.adsbygoogle", "div.banner-ad"],
    "after": ["footer", "div.footer", "aside", "div.sidebar", "aside.sidebar", "div.related", "section.related", "div.widget", "div.share", "div.social", "div.copyright", "div.tags", "ul.links", "div.recommended", "div.author-box"],
    "form": ["form", "form.newsletter", "div.subscribe", "form.search", "div.signup", "form.login", "form.comment-form"],
    "comments": ["section.comments", "div.comments", "ol.commentlist", "div.comment-list", "div#disqus", "section.reader-comments", "div.replies", "div.comment"],
}
TEACHER_CONTENT = {"article", "main"}
TEACHER_OTHER = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "label"}
TEACHER_NAMES = {re.sub(r"^[a-z]+[.#]?", "", x) for kind in LAYOUT.values() for x in kind} - {""}


def taught(path: tuple) -> bool:
    """The teacher: inside an article or main element (or body text proper), and in nothing that is named as boilerplate."""
    return not _boilerplate(path) and any(tag in TEACHER_CONTENT for tag, *_ in path)


def _boilerplate(path: tuple) -> bool:
    """Whether an element below body is boilerplate by its tag or by a whole class, id or role name."""
    return any(tag in TEACHER_OTHER or tag not in ("html", "body") and any(not TEACHER_NAMES.isdisjoint(x) for x in whole) for tag, _, *whole in path)


def _element(spec: str) -> tuple:
    m = re.match(r"([a-z]+)(?:[.#](.*))?$", spec)
    return m[1], tuple(_words(m[2] or ""))


def relaid(found: list[tuple[str, tuple, float]], good: list[bool], rng: np.random.Generator) -> tuple[list, list[bool]]:
    """The page's blocks in a random layout: its content in a content element, other blocks in named boilerplate around and inside."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    root = (("html", ()), ("body", ()))
    if rng.random() < 0.5:
        root += (_element(pick(["div.wrapper", "div.container", "div.page", "div.site", "div.row", "div.layout"])),)
    text = [b for b, g in zip(found, good, strict=True) if g]
    rest = [b[0] for b, g in zip(found, good, strict=True) if not g] or ["Home"]
    words = " ".join(b[0] for b in text).split() or rest

    def unnamed() -> str:
        return f"{pick(['div', 'div', 'div', 'section', 'td', 'ul'])}.{''.join(pick('jkqvwxz') for _ in range(5))}"

    def noise(element: tuple) -> tuple:
        """The element, at times with a further class word that says nothing, and at times inside wrappers of that kind."""
        tag, names = element
        extra = _words(unnamed())[1:] if rng.random() < 0.4 else []
        return tuple(_element(unnamed()) for _ in range(max(0, int(rng.integers(-2, 3))))) + ((tag, (*names, *extra)),)

    def remarks() -> list:
        """Reader comments in a container whose name says nothing: items of a name and a text."""
        spec = noise(_element(unnamed()))
        item = pick([(), (), (("div", ()),), (("li", ()),), (("div", ()), ("div", ())), (_element(unnamed()),)])
        out = []
        for _ in range(int(rng.integers(2, 7))):
            if rng.random() < 0.6:
                out.append((" ".join(words[int(rng.integers(len(words)))] for _ in range(int(rng.integers(1, 4)))), root + spec + item + pick([(), (("h4", ()),), (("p", ()),)]), float(rng.random() < 0.3)))
            m = int(rng.integers(5, 45))
            k = int(rng.integers(0, max(1, len(words) - m)))
            out.append((" ".join(words[k : k + m]), root + spec + item + pick([(), (("p", ()),), (("p", ()),)]), 0.0))
        return out

    def some(kind: str, named: bool = False) -> list:
        bare = not named and rng.random() < UNNAMED and kind not in ("comments", "notice", "advert")
        spec = noise(_element(unnamed() if bare else pick(LAYOUT[kind])))
        long = not bare and (kind in ("comments", "notice", "advert") or rng.random() < 0.3)
        out = []
        direct = kind == "advert" and rng.random() < 0.5  # one text, straight in its element
        for _ in range(1 if direct else int(rng.integers(1, 6))):
            m = int(rng.integers(4, 60)) if long else int(rng.integers(1, 6))
            k = int(rng.integers(0, max(1, len(words) - m)))
            body = " ".join(words[k : k + m]) if rng.random() < 0.7 else pick(rest)
            inner = () if direct else pick([(), (_element(f"p.{unnamed().split('.')[1]}"),), (("p", ()),), (("li", ()),), (("ul", ()), ("li", ())), (("div", ()),), (("span", ()),), (("h3", ()),)])
            linked = float(rng.random() < (0.8 if kind == "before" or bare else 0.3))
            out.append((body, root + spec + tuple(p for p in inner if p[0] in PARTING), linked))
        return out

    top = [x for kind in ("before", "notice", "advert", "before") if rng.random() < 0.6 for x in some(kind)]
    end = [x for kind in ("after", "form", "comments", "advert", "notice", "after") if rng.random() < 0.5 for x in some(kind)]
    spec = unnamed() if rng.random() < UNNAMED else pick(CONTENT)
    leaf = pick(["div", "td", "span", "li"]) if rng.random() < 0.2 else ""  # a page that has no paragraphs
    shell = root + noise(_element(spec))
    if rng.random() < 0.25:
        shell += (_element(pick(CONTENT)),)
    body, marks = [], []
    all_linked = rng.random() < 0.12
    for b in [*text, None]:
        if b and rng.random() < 0.06:  # a table of short cells, or code
            rows, cells = int(rng.integers(2, 6)), int(rng.integers(2, 5))
            for k in range(rows * cells):
                cell = str(int(rng.integers(2000))) if rng.random() < 0.4 else " ".join(words[int(rng.integers(len(words)))] for _ in range(int(rng.integers(1, 4))))
                body.append((cell, shell + (("table", ()), ("tr", ()), ("th" if k < cells and rng.random() < 0.5 else "td", ())), 0.0))
                marks.append(True)
        if b and rng.random() < 0.05:
            m, k = int(rng.integers(1, 30)), int(rng.integers(len(words)))
            body.append((" ".join(words[k : k + m]) + pick([" { }", " = 1", "();", ""]), shell + (("pre", ()),), 0.0))
            marks.append(True)
        if b and rng.random() < (0.25 if not body else 0.06):  # a heading, at times in a container of its own
            k = int(rng.integers(len(words)))
            body.append((" ".join(words[k : k + int(rng.integers(1, 6))]), shell + ((_element(f"div.{unnamed().split('.')[1]}"),) if rng.random() < 0.5 else ()) + ((pick(["h1", "h2", "h2", "h3"]), ()),), 0.0))
            marks.append(True)
        if rng.random() < (0.4 if body and not marks[-1] else 0.08):  # a list in or after the running text
            for _ in range(int(rng.integers(2, 7))):
                m, k = int(rng.integers(1, 8) if rng.random() < 0.5 else rng.integers(1, 25)), int(rng.integers(len(words)))
                body.append((" ".join(words[k : k + m]), shell + (("ul", ()), ("li", ())), 0.0))
                marks.append(True)
        if b is None:
            break
        tag = b[1][-1][0] if b[1] and b[1][-1][0] not in TEACHER_CONTENT else "p"
        if rng.random() < 0.08:
            tag = pick(["blockquote", "li", "h2", "pre", "div", "td", "h3"])
        tag = leaf if leaf and tag == "p" else tag
        own = (_element(f"div.{unnamed().split('.')[1]}"),) if body and b is not text[-1] and rng.random() < 0.04 else ()
        body.append((b[0], shell + own + (((tag, ()),) if tag in PARTING else ()), 1.0 if rng.random() < (0.9 if all_linked else 0.04) else b[2]))
        marks.append(True)
        if rng.random() < 0.3:
            for x in some(pick(["advert", "advert", "advert", "after", "form", "notice", "comments"]), named=True)[: int(rng.integers(1, 4))]:
                body.append((x[0], shell + x[1][len(root) :], x[2]))
                marks.append(False)
    if rng.random() < 0.15 and text:  # comments inside the content element
        for x in some("comments"):
            body.append((x[0], shell + x[1][len(root) :], x[2]))
            marks.append(False)
    if rng.random() < 0.4:
        end = remarks() + end
    return top + body + end, [False] * len(top) + marks + [False] * len(end)


def train(pages: list[str], seed: int = 7, layouts: int = 4, longest: int = 80) -> Network:
    rng = np.random.default_rng(seed)
    layouts = max(layouts, -(-EXAMPLES // max(1, len(pages))))
    examples = []
    parted = [blocks(page) for page in pages]
    known = frozenset(w for kind in (CONTENT, *LAYOUT.values()) for x in kind for w in _element(x)[1]) | {w for found in parted for _, path, _ in found for _, names, *_ in path for w in names}

    def lay(found: list, good: list[bool]) -> None:
        for _ in range(layouts):
            laid, marks = relaid(found, good, rng)
            examples.append((features(laid, known), np.array(marks, np.float32)))

    for found in parted:
        good = [taught(p) for _, p, _ in found]
        if any(good):  # a page without semantic markup teaches nothing, above all not that its text is boilerplate
            examples.append((features(found, known), np.array(good, np.float32)))
            lay(found, good)
    if not examples:  # no page has any: their running text is set into layouts whose labels are known
        for found in parted:
            good = [not _boilerplate(p) and linked < 0.3 and len(text.split()) >= 10 for text, p, linked in found]
            if any(good):
                lay(found, good)
    net = Network.fresh(rng, known)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    cut = [(x[a : a + longest], y[a : a + longest]) for x, y in examples for a in range(0, len(x), longest)]
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS)
        order = sorted(rng.permutation(len(cut)).tolist(), key=lambda k: len(cut[k][0]) // 8)
        groups = [order[a : a + 32] for a in range(0, len(order), 32)]
        for g in rng.permutation(len(groups)):
            x, mask = padded([cut[k][0] for k in groups[g]])
            y, _ = padded([cut[k][1][:, None] for k in groups[g]])
            step += 1
            for k, d in net.gradients(x, mask, y[:, :, 0]).items():
                d = np.clip(d, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                net.w[k] = (net.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def label(net: Network, pages: list[list[tuple[str, tuple, float]]]) -> list[np.ndarray]:
    """A content score for each block of each page. Pages of like length share a run; a run holds about 4,000 blocks."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and b - a < 128 and (b - a + 1) * len(pages[order[b]]) <= 4000:
            b += 1
        x, mask = padded([features(pages[k], net.known) for k in order[a:b]])
        scores = net.scores(x, mask)
        for col, k in enumerate(order[a:b]):
            out[k] = scores[: len(pages[k]), col]
        a = b
    return out


def _extracted(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*held.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                found = [blocks(x.as_py() or "") for x in part.column("html")]
                texts = ["\n".join(b[0] for b, s in zip(f, scores, strict=True) if s > 0.5) for f, scores in zip(found, label(net, found), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def fit(pages: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Network:
    """Trains on `sample` pages: those of at most `longest` characters first, by the least hashes of page_id (ties by html).

    The pages are chosen by their keys, and only the chosen ones are fetched, `longest` characters of each at most, so the
    driver gets sample x longest characters whatever the pages are.
    """
    rows = pages.where("html is not null").select("page_id", "html", F.xxhash64("html").alias("h"))
    keys = rows.select("page_id", "h", (F.length("html") > longest).alias("long"))
    chosen = keys.orderBy("long", F.xxhash64("page_id"), "page_id", "h").limit(sample).select("page_id", "h").distinct()
    some = rows.join(F.broadcast(chosen), rows["page_id"].eqNullSafe(chosen["page_id"]) & (rows["h"] == chosen["h"]), "left_semi")
    some = some.groupBy("page_id", "h").agg(F.first(F.substring("html", 1, longest)).alias("html"))
    return train([r.html for r in sorted(some.collect(), key=lambda r: (r.page_id is None, r.page_id, r.h))])


def extract(pages: DataFrame, net: Network) -> DataFrame:
    """page_id, url, text for each row of pages (page_id, url, html)."""
    held = pages.sparkSession.sparkContext.broadcast((net.w, net.known))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted(held), "page_id long, url string, text string")


def op8(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("long"))
