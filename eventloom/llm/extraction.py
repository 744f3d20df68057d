"""The main text of web pages: a bidirectional LSTM in numpy labels every block of a page, using all of the page.

A page is cut into blocks, runs of text between the edges of block elements, each with the path of elements above it. A
block is read as hashed tag-path tokens (names, classes, ids and roles of the elements above it), hashed words and some
statistics; the LSTM reads the blocks of a page forwards and backwards and says for each whether it is main text. It is
trained here, on pages that are made by rule, in many layouts and with invented words, so that it is the same for every
table and learns places rather than words.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.llm.common import rows_as

#: Buckets of path tokens and of words, components of what stands for them, and units of the LSTM in each direction.
PATHS, WORDS, INPUT, UNITS = 4096, 512, 24, 24
#: Made pages to learn from, passes over them, pages a step.
PAGES, PASSES, STEP = 3000, 2, 16
#: Blocks whose features a worker holds at once; a page of more is read by itself.
BLOCKS_AT_ONCE = 16_384
SEED = 11

# How HTML names its elements.
#: Elements whose edges part blocks.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul title".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; all but textarea and title are no text either.
RAW = frozenset("script style textarea title noembed noframes iframe xmp".split())
#: Elements whose text is never shown as text.
HIDDEN = frozenset("head script style title template noembed noframes iframe textarea select option datalist svg math object audio video canvas noscript button".split())
#: What the start of an element ends, if it is open inside the nearest of the elements behind it.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "thead": (frozenset({"tbody", "tfoot", "thead"}), frozenset({"table"})), "tbody": (frozenset({"tbody", "tfoot", "thead"}), frozenset({"table"})), "tfoot": (frozenset({"tbody", "thead"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})), "body": (frozenset({"head"}), frozenset()),
}
#: Elements that end an open paragraph.
ENDS_P = BLOCK - frozenset("body button caption dd dt head html legend li optgroup option select tbody td template tfoot th thead title tr".split())

_PART = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|</([a-zA-Z][^\s/>]*)[^>]*+>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z](?=[^>]*+\Z).*\Z", re.S)
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_a-zA-Z]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block:
    """A block's text, the path tokens of all elements above it and of the nearest one, the share of its characters in links, and whether it is shown."""

    __slots__ = ("text", "path", "own", "linked")

    def __init__(self, text: str, path: frozenset, own: tuple, linked: float):
        self.text, self.path, self.own, self.linked = text, path, own, linked


@functools.lru_cache(1 << 14)
def _tokens(name: str, attributes: str) -> tuple[tuple[int, ...], bool]:
    """(hashed tokens of an element, whether it is hidden): its name, and the words of its class, id, role and itemprop."""
    found, hidden = [name], name in HIDDEN
    for m in _NAMED.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _NOT_SHOWN.search(value):
            hidden = True
        elif key in ("class", "id", "role", "itemprop"):
            found += ["." + w.lower() for w in _TOKEN.findall(html.unescape(value))]
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) % PATHS for x in dict.fromkeys(found)), hidden


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, without those that are not shown.

    A tree is followed by its open elements: void elements have no content, scripts and the like no markup, list items,
    cells and paragraphs end where the next one starts, and an end tag ends
    the nearest open element of its name, an inline one's only within a block. What looks like a tag but isn't stays text.
    White space is one space each, at the ends none; empty blocks are left out.
    """
    page = page or ""
    out: list[Block] = []
    names: list[str] = []
    # of each open element: its tokens, and the tokens of all above it and itself
    paths: list[frozenset] = [frozenset()]
    owns: list[tuple] = [()]
    many: Counter = Counter()
    hidden, links, held, linked, at = 0, 0, [], 0, 0
    veils: list[bool] = []

    def say(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            held.append(text)
            if links:
                linked += len(text)

    def end() -> None:
        nonlocal linked
        if held:
            text = "".join(held)
            shown = " ".join(html.unescape(text).split())
            if shown:
                out.append(Block(shown, paths[-1], owns[-1], min(1.0, linked / len(text))))
            held.clear()
            linked = 0

    def leave(to: int) -> None:
        """End all open elements from the place `to` on."""
        nonlocal hidden, links
        while len(names) > to:
            name = names.pop()
            many[name] -= 1
            if name in BLOCK:
                end()
            hidden -= veils.pop()
            links -= name == "a"
            paths.pop()
            owns.pop()

    def inside(those: frozenset, limits: frozenset) -> int | None:
        """The place of the outermost of those elements that is open within the nearest limit."""
        found = None
        for i in range(len(names) - 1, -1, -1):
            if names[i] in limits:
                break
            if names[i] in those:
                found = i
        return found

    while True:
        m = _PART.search(page, at)
        if not m:
            break
        say(page[at : m.start()])
        at = m.end()
        if m[1]:
            name, attributes = m[1].lower(), m[2]
            closes = ENDS.get(name)
            if closes and (place := inside(*closes)) is not None:
                leave(place)
            if name in ENDS_P and many["p"] and (place := inside(_P, _P_LIMITS)) is not None:
                leave(place)
            if name in BLOCK:
                end()
            if name == "br":
                say(" ")
            if name in VOID:
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
                continue
            own, veiled = _tokens(name, attributes)
            names.append(name)
            many[name] += 1
            veils.append(veiled)
            hidden += veiled
            links += name == "a"
            plain = name not in BLOCK
            paths.append(paths[-1] if plain or paths[-1].issuperset(own) else paths[-1].union(own))
            owns.append(owns[-1] if plain else own)
        elif m[3]:
            name = m[3].lower()
            if many[name]:
                place = len(names) - 1
                while names[place] != name and (name in BLOCK or names[place] not in BLOCK):
                    place -= 1
                if names[place] == name:
                    leave(place)
            elif name == "p":
                end()
    say(page[at:])
    end()
    return out


_P, _P_LIMITS = frozenset({"p"}), frozenset("table td th caption button object".split())
#: Statistics of a block beside its tokens.
STATISTICS = 8


class Features:
    """What the model reads of a row of blocks: token numbers with the block each belongs to, and statistics."""

    def __init__(self, found: list[Block]):
        self.n = len(found)
        path = [sorted(b.path) for b in found]
        self.path, self.path_of = _flat(path)
        self.own, self.own_of = _flat([b.own for b in found])
        words = [np.fromiter(map(zlib.crc32, b.text.lower().encode("utf-8", "replace").split()), np.uint32) % WORDS for b in found]
        self.word = np.concatenate(words).astype(np.int64) if words else np.zeros(0, np.int64)
        many = np.array(list(map(len, words)), np.int64)
        self.word_of = np.repeat(np.arange(self.n), many)
        chars = np.array([len(b.text) for b in found], float)
        ends = [b.text[-1:] for b in found]
        self.stats = np.stack([
            np.log1p(chars) / 5, np.log1p(many) / 4, np.array([b.linked for b in found], float), chars / np.maximum(many, 1) / 10,
            np.array([e in ".!?。！？…:;»”\"" for e in ends], float), np.array([len(b.path) for b in found], float) / 20,
            np.array([sum(b.text.count(c) for c in ".,;") for b in found], float) / np.maximum(many, 1), np.ones(self.n),
        ], axis=1).astype(np.float32) if found else np.zeros((0, STATISTICS), np.float32)


def _flat(rows) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter((x for r in rows for x in r), np.int64), np.repeat(np.arange(len(rows)), list(map(len, rows)))


def _share(of: np.ndarray, n: int, mean: bool) -> np.ndarray:
    """What each of n blocks' tokens weigh: one, or as a mean."""
    return (2 / np.maximum(np.bincount(of, minlength=n), 1) if mean else np.ones(n))[:, None].astype(np.float32)


def _sum(table: np.ndarray, number: np.ndarray, of: np.ndarray, n: int, mean: bool) -> np.ndarray:
    """The sum, or twice the mean, of the table's rows that belong to each of n blocks."""
    out = np.zeros((n, table.shape[1]), table.dtype)
    start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else of
    if len(of):
        out[of[start]] = np.add.reduceat(table[number], start, axis=0)
    return out * _share(of, n, mean)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The bidirectional LSTM. Weights: tables of path tokens, own tokens and words, the input of the statistics, both directions and the outcome."""

    def __init__(self, seed: int = SEED):
        rnd = np.random.default_rng(seed)
        normal = lambda *shape, by: (rnd.standard_normal(shape) * by).astype(np.float32)
        self.w = {"path": normal(PATHS, INPUT, by=0.1), "own": normal(PATHS, INPUT, by=0.1), "word": normal(WORDS, INPUT, by=0.1), "stats": normal(STATISTICS, INPUT, by=0.3)}
        for way in ("f", "b"):
            self.w |= {f"{way}x": normal(INPUT, 4 * UNITS, by=INPUT**-0.5), f"{way}h": normal(UNITS, 4 * UNITS, by=UNITS**-0.5), f"{way}0": np.repeat(np.array([0, 1, 0, 0], np.float32), UNITS)}
        self.w |= {"out": normal(2 * UNITS + INPUT, by=0.2), "out0": np.zeros(1, np.float32)}

    def read(self, f: Features) -> np.ndarray:
        w = self.w
        return np.tanh(_sum(w["path"], f.path, f.path_of, f.n, False) + _sum(w["own"], f.own, f.own_of, f.n, False) + _sum(w["word"], f.word, f.word_of, f.n, True) + f.stats @ w["stats"])

    def run(self, x: np.ndarray, lengths: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """The states of one direction for pages laid one after another in x, with those lengths. Pages go side by side, a step at a time; those that have ended drop out."""
        start = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        lasting = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max(initial=0)) + 1), side="right")
        gates_x = x @ self.w[f"{way}x"] + self.w[f"{way}0"]
        out = np.zeros((len(x), UNITS), np.float32)
        h = c = np.zeros((len(lengths), UNITS), np.float32)
        for t, n in enumerate(lasting.tolist()):
            at = start[order[:n]] + (t if way == "f" else lengths[order[:n]] - 1 - t)
            h, c = h[:n], c[:n]
            g = gates_x[at] + h @ self.w[f"{way}h"]
            i, f, o = (_sigmoid(g[:, k * UNITS : (k + 1) * UNITS]) for k in range(3))
            u = np.tanh(g[:, 3 * UNITS :])
            before = (h, c)
            c = f * c + i * u
            s = np.tanh(c)
            h = o * s
            out[at] = h
            if keep is not None:
                keep.append((at, *before, i, f, o, u, s))
        return out

    def score(self, f: Features, lengths: np.ndarray) -> np.ndarray:
        """The probability of each block to be main text."""
        x = self.read(f)
        both = np.concatenate((self.run(x, lengths, "f"), self.run(x, lengths, "b"), x), axis=1)
        return _sigmoid(both @ self.w["out"] + self.w["out0"])

    def gradients(self, f: Features, lengths: np.ndarray, want: np.ndarray) -> tuple[float, dict]:
        """(mean log loss, gradients of all weights) for labelled blocks."""
        w, x = self.w, self.read(f)
        kept: dict = {"f": [], "b": []}
        both = np.concatenate((*(self.run(x, lengths, way, kept[way]) for way in "fb"), x), axis=1)
        p = _sigmoid(both @ w["out"] + w["out0"])
        d = ((p - want) / max(len(want), 1)).astype(np.float32)
        g = {"out": both.T @ d, "out0": d.sum(keepdims=True)}
        d_both = d[:, None] * w["out"]
        d_x = d_both[:, 2 * UNITS :].copy()
        for k, way in enumerate("fb"):
            d_h_out = d_both[:, k * UNITS : (k + 1) * UNITS]
            d_gates = np.zeros((len(x), 4 * UNITS), np.float32)
            g[f"{way}h"] = np.zeros_like(w[f"{way}h"])
            d_h = d_c = np.zeros((0, UNITS), np.float32)
            for at, h0, c0, i, forget, o, u, s in reversed(kept[way]):
                grow = lambda m: np.concatenate((m, np.zeros((len(at) - len(m), UNITS), np.float32)))  # noqa: B023,E731
                d_h, d_c = grow(d_h) + d_h_out[at], grow(d_c)
                d_c = d_c + d_h * o * (1 - s * s)
                step = np.concatenate((d_c * u * i * (1 - i), d_c * c0 * forget * (1 - forget), d_h * s * o * (1 - o), d_c * i * (1 - u * u)), axis=1)
                d_gates[at] = step
                g[f"{way}h"] += h0.T @ step
                d_h, d_c = step @ w[f"{way}h"].T, d_c * forget
            g[f"{way}x"], g[f"{way}0"] = x.T @ d_gates, d_gates.sum(0)
            d_x += d_gates @ w[f"{way}x"].T
        d_in = d_x * (1 - x * x)
        g["stats"] = f.stats.T @ d_in
        for name, number, of in (("path", f.path, f.path_of), ("own", f.own, f.own_of), ("word", f.word, f.word_of)):
            g[name] = np.zeros_like(w[name])
            np.add.at(g[name], number, (d_in * _share(of, f.n, name == "word"))[of])
        loss = -np.mean(np.where(want > 0, np.log(np.maximum(p, 1e-7)), np.log(np.maximum(1 - p, 1e-7)))) if len(want) else 0.0
        return float(loss), g

    def fit(self, pages: list[tuple[list[Block], list[int]]], passes: int = PASSES, seed: int = SEED, rate: float = 0.02) -> Labeller:
        """Adam over labelled pages. Some path tokens and words are left out at random, so that no single one decides."""
        rnd = np.random.default_rng(seed)
        first, second, step = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        for turn in range(passes):
            order = rnd.permutation(len(pages))
            for s in range(0, len(order), STEP):
                some = [pages[i] for i in order[s : s + STEP]]
                f = Features([b for found, _ in some for b in found])
                for name, lost in (("path", 0.03), ("own", 0.03), ("word", 0.6)):
                    keep = rnd.random(len(getattr(f, name))) > lost
                    setattr(f, name, getattr(f, name)[keep])
                    setattr(f, f"{name}_of", getattr(f, f"{name}_of")[keep])
                _, g = self.gradients(f, np.array([len(found) for found, _ in some]), np.array([y for _, want in some for y in want], np.float32))
                step += 1
                now = rate * (1 - turn / passes) + 1e-4
                for k, v in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    self.w[k] = (self.w[k] - now * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


# Pages made to learn from

# Words of interfaces and names of classes that such pages carry.
CLASSES = {
    "menu": "nav navbar menu main-menu topnav site-nav navigation breadcrumb breadcrumbs skip-link pagination toc tabs",
    "header": "header site-header masthead top-bar banner logo branding tagline page-head hero-bar",
    "footer": "footer site-footer colophon copyright legal bottom page-foot footer-links imprint",
    "sidebar": "sidebar aside side-bar widget related related-posts recommended more-stories most-read trending tag-cloud archive-list rail secondary",
    "notice": "cookie-notice cookie-banner consent gdpr alert notice toast popup modal paywall subscribe-wall announcement",
    "advert": "ad ads advert advertisement sponsored promo banner-ad ad-slot outbrain teaser commercial",
    "form": "search-form newsletter signup subscribe login contact-form poll feedback form",
    "comments": "comments comment comment-list respond discussion disqus replies reader-comments thread user-comment",
    "share": "share social share-buttons social-links toolbar",
    "article": "article content post entry entry-content post-content article-body story story-body main-content text body-text page-content post-body blog-post news-detail",
    "plain": "wrap wrapper container row col inner box block layout page grid section outer",
}
SAYINGS = {
    "menu": "home|about us|contact|products|news|sports|culture|blog|start|login|sign in|register|skip to content|next|previous|menu|accueil|nosotros|über uns|kontakt|inicio|search|all topics|archive",
    "header": "the daily|your news every day|free delivery|est. 1999|online magazine|official site|welcome|english|deutsch|menu",
    "footer": "© 2024 all rights reserved|privacy policy|terms of use|imprint|impressum|cookie settings|powered by|contact us|sitemap|accessibility|tous droits réservés|alle rechte vorbehalten|copyright",
    "sidebar": "related articles|most read|you may also like|popular posts|recent posts|archives|categories|tags|trending now|editor's picks|read more|latest news|follow us",
    "notice": "we use cookies to improve your experience|accept all|reject|manage preferences|this site uses cookies|by continuing you agree|got it|you have 3 free articles left|javascript is required|breaking news alert",
    "advert": "advertisement|sponsored|buy now|special offer|click here|anzeige|publicité|publicidad|save 50%|limited time offer|shop now|promoted",
    "form": "subscribe to our newsletter|your e-mail|sign up|search|send|submit|name|password|log in|enter your email address|i accept the terms|your message",
    "comments": "reply|comments|leave a comment|says|report|5 replies|log in to comment|great article|thanks for sharing|i disagree|posted by|like|show more comments",
    "share": "share|tweet|facebook|print|e-mail this|copy link|share this article|pin it|whatsapp",
}
LETTERS = ("aeiourstnlmdcpbghfvk", "aeiouéèàçôrstnlmdpqu", "aeiouäöüßnrstdhgchsl", "аеиоуыктснврлмпдгзб", "的一是不了人我在有他这中大来上国")


class Writer:
    """Makes pages by rule from a seed: main parts in many layouts among menus, headers, footers, sidebars, notices, adverts, forms and comments."""

    def __init__(self, seed: int):
        self.rnd = random.Random(seed)
        letters = self.rnd.choice(LETTERS)
        self.words = ["".join(self.rnd.choices(letters, k=self.rnd.randint(1, 9))) for _ in range(200)]

    def text(self, low: int, high: int) -> str:
        r = self.rnd
        found = [r.choice(self.words) + r.choice(["", "", "", "", "", ",", ".", ";"]) for _ in range(r.randint(low, high))]
        found = [w.capitalize() if r.random() < 0.1 else w for w in found]
        if r.random() < 0.1:
            found = [w + r.choice(["%%%", "***", "&amp;&amp;", "###", "$$$"]) for w in found]
        text = " ".join(found)
        return (text.upper() if r.random() < 0.05 else text.capitalize()) + r.choice([".", ".", ".", "", "!", "?"])

    def prose(self) -> str:
        """A main block's text: often long, sometimes a word or two."""
        return self.text(*self.rnd.choice([(1, 3), (1, 3), (3, 10), (8, 40), (30, 120)]))

    def says(self, kind: str) -> str:
        """A short text of an interface: its usual words, or any words."""
        r = self.rnd
        return r.choice(SAYINGS[kind].split("|")).capitalize() if kind in SAYINGS and r.random() < 0.5 else self.text(1, r.choice([3, 6, 25]))

    def tag(self, kind: str, names: list[str]) -> tuple[str, str]:
        """A start and an end tag: by name, by class, by id or by role."""
        r = self.rnd
        name = r.choice(names)
        attributes = ""
        bare = kind == "article" and r.random() < 0.1
        if name in ("div", "section", "ul", "p") and not bare or r.random() < 0.3:
            how = r.choice(["class", "class", "id"])
            value = r.choice(CLASSES[kind].split())
            if how == "class" and r.random() < 0.4:
                value += " " + r.choice(CLASSES["plain"].split())
            attributes = f' {how}="{value}"' if r.random() < 0.9 else f" {how}={value.split()[0]}"  # some without quotes
        return f"<{name}{attributes}>", f"</{name}>"

    def mark(self, text: str, main: bool) -> str:
        """Inline markup around some of a text; * at the start stands for a main block."""
        r = self.rnd
        if r.random() < 0.25:
            words = text.split(" ")
            i = r.randrange(len(words))
            words[i] = r.choice(['<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "<span class='x'>{}</span>", "<code>{}</code>"]).format(words[i])
            text = " ".join(words)
        if r.random() < 0.1:
            text = "<b>" + text + "<br>"
        return (MAIN if main else "") + text

    def links(self, kind: str) -> str:
        r = self.rnd
        items = [f'<a href="/{i}">{self.says(kind)}</a>' for i in range(r.randint(1, 8))]
        form = r.choice(["<ul>{}</ul>", "<ol>{}</ol>", "{}", "<p>{}</p>"])
        return form.format("".join(f"<li>{x}</li>" for x in items) if "l>" in form else r.choice([" | ", " ", " &middot; "]).join(items))

    def prose_of(self, kind: str) -> str:
        return "".join(f"<p>{self.mark(self.says(kind), False)}</p>" for _ in range(self.rnd.randint(1, 3))) if self.rnd.random() < 0.6 else self.mark(self.says(kind), False)

    def other(self, kind: str) -> str:
        """A part that is no main text."""
        r = self.rnd
        names = {"menu": ["nav", "nav", "div", "ul", "menu"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "sidebar": ["aside", "aside", "div", "section"], "form": ["form"], "comments": ["section", "div", "ul"]}
        start, end = self.tag(kind, names.get(kind, ["div", "div", "section", "aside", "p"]))
        if kind == "menu" or kind == "share":
            body = self.links(kind)
        elif kind == "header":
            body = r.choice(["<h1>{}</h1>", "<p>{}</p>", "<div>{}</div>", "{}"]).format(self.says(kind)) + (self.other("menu") if r.random() < 0.4 else "")
        elif kind == "form":
            body = f"<label>{self.says(kind)}</label><input name=q><button>{self.says(kind)}</button>" + (f"<p>{self.says(kind)}</p>" if r.random() < 0.5 else "")
        elif kind == "comments":
            body = r.choice(["", f"<h2>{self.says(kind)}</h2>", f"<h3>{self.says(kind)}</h3>"])
            for _ in range(r.randint(1, 6)):
                a, b = self.tag("comments", ["div", "div", "article", "li"]) if r.random() < 0.7 else ("<div>", "</div>")
                body += f"{a}<p>{self.text(1, 2)}</p>" + "".join(f"<p>{self.mark(self.prose(), False)}</p>" for _ in range(r.randint(1, 2))) + b
            if r.random() < 0.3:
                body += self.other("form")
        elif kind == "sidebar":
            body = r.choice(["", f"<h3>{self.says(kind)}</h3>", f"<h2>{self.says(kind)}</h2>"]) + r.choice([self.links, self.prose_of])(kind)
        elif kind == "footer":
            body = r.choice([self.links, self.prose_of])(kind) + (f"<p>&copy; {self.text(1, 8)}</p>" if r.random() < 0.4 else f"&copy; {self.text(1, 20)}" if r.random() < 0.5 else "")
        else:
            body = self.prose_of(kind)
        return start + body + end

    def main(self) -> str:
        r = self.rnd
        parts = [f"<h1>{MAIN}{self.text(2, 14)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([0, 1, 2, 3, 5, 9, 20])):
            kind = r.random()
            if kind < 0.08:  # one short paragraph over and over, or many different ones
                text, many = self.text(1, 4), r.choice([3, 8, 30])
                parts += [f"<p>{MAIN}{text if r.random() < 0.5 else self.text(1, 4)}</p>" for _ in range(many)] if r.random() < 0.4 else [f"<p>{MAIN}{text}</p>"] * many
            elif kind < 0.68:
                parts.append(f"<p>{self.mark(self.prose(), True)}" + ("</p>" if r.random() < 0.9 else ""))
            elif kind < 0.76:
                parts.append(f"<h{(n := r.choice('234'))}>{MAIN}{self.text(1, 8)}</h{n}>")
            elif kind < 0.82:
                parts.append(r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{self.mark(self.text(1, 25), True)}</li>" for _ in range(r.randint(1, 6)))))
            elif kind < 0.86:
                parts.append(f"<blockquote><p>{MAIN}{self.prose()}</p></blockquote>")
            elif kind < 0.89:
                parts.append(f"<pre>{MAIN}{self.text(3, 40)}</pre>")
            elif kind < 0.92:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{MAIN}{self.text(1, 4)}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.95:
                parts.append(f"<figure><img src=x><figcaption>{MAIN}{self.text(3, 15)}</figcaption></figure>")
            else:
                parts.append(f"<div>{self.mark(self.prose(), True)}</div>")
        if not parts:
            parts.append(f"<p>{MAIN}{self.prose()}</p>")
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            parts.insert(r.randrange(len(parts) + 1), self.other(r.choice(["advert", "notice", "share", "sidebar", "form"])))
        if r.random() < 0.25:
            parts.append(self.other("comments"))
        body = "".join(parts)
        start, end = self.tag("article", ["article", "article", "article", "main", "div", "section"])
        if r.random() < 0.3:
            more, less = self.tag("article", ["article", "div", "section"])
            body = more + body + less
        return start + body + end

    def page(self) -> str:
        r = self.rnd
        some = lambda kinds, p: "".join(self.other(k) for k in kinds if r.random() < p)
        middle = self.main() + (self.other("comments") if r.random() < 0.4 else "")
        if r.random() < 0.4:
            middle = r.choice(["<main>{}</main>", '<div class="wrapper">{}</div>', '<div id="page" class="container">{}</div>']).format(self.other("sidebar") + middle if r.random() < 0.4 else middle + some(["sidebar"], 0.7))
        before, after = ["notice", "header", "menu", "form", "advert", "menu", "sidebar"], ["comments", "sidebar", "advert", "share", "form", "menu", "footer", "notice"]
        body = some(before, 0.35) + middle + some(after[:-2], 0.25) + some(after[-2:], 0.6)
        head = f"<head><title>{self.text(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>" if r.random() < 0.9 else body


#: Marks a main block in made pages; a character that no text of theirs has.
MAIN = "\ue000"


def made_pages(n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """n made pages as blocks with their labels."""
    pages = []
    for i in range(n):
        found = blocks(Writer(seed * 1_000_003 + i).page())
        labels = [int(MAIN in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(MAIN, "")
        pages.append((found, labels))
    return pages


@functools.lru_cache(1)
def trained() -> Labeller:
    """The labeller fitted on made pages; some seconds, once a driver. The same weights for every table."""
    return Labeller().fit(made_pages(PAGES, SEED))


def texts_of(model: Labeller, pages: list[list[Block]]) -> list[str]:
    """The main text of each page, given as blocks."""
    out = []
    lengths = list(map(len, pages))
    start = 0
    while start < len(pages):
        stop, held = start + 1, lengths[start]
        while stop < len(pages) and held + lengths[stop] <= BLOCKS_AT_ONCE:
            held += lengths[stop]
            stop += 1
        some = pages[start:stop]
        score = model.score(Features([b for found in some for b in found]), np.array(lengths[start:stop])) if held else np.zeros(0)
        keep = iter((score >= 0.5).tolist())
        out += ["\n".join([b.text for b in found if next(keep)]) for found in some]
        start = stop
    return out


def extract(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the blocks that the labeller takes for main text, joined by line feeds.

    A null or empty page, and one of no main text, has an empty text of no characters; null ids and urls stay null;
    repeated rows stay; extra columns are ignored; an empty table gives no rows. Pages are read whole, however long; rows
    stay where they are. Breaks inside a block are white space; hidden elements are no text.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def batches(rows):
        for b in rows:
            texts = texts_of(shared.value, [blocks(t.as_py()) for t in b.column(2)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kept = rows_as(pages, page_id=id_col, url=url_col, html=html_col).selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return kept.mapInArrow(batches, "page_id long, url string, text string, n_chars long")
