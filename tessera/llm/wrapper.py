"""Wrapper induction for pages of one host (problem 6).

A page is a stream of line tokens: mark-up with its classes, and whether text stands in it. A wrapper is
a union-free regular expression over such tokens: a list of nodes, each of which is constant (a text that
the host's pages repeat), or a slot for texts, or bare mark-up; required or optional (seen on some pages);
single or repeated (seen several times in a row). Pages are folded into it one by one. Texts that many
pages of a block have in common are tokens of their own, so they anchor the alignment; tokens that align
(longest matching blocks) join a node; where the streams differ, the surplus tokens become optional nodes,
and runs of the same token a repeated node. Two wrappers merge in the same way, so partial wrappers of a
large host can be built in many tasks and merged in a tree.

A text counts as repeated if pages with different page keys have it. A page key is six hash minima over the
word triples of the page's long lines, so that copies and near copies of one page don't make its sentences
look like part of the frame.

``Layout`` reads the finished wrapper: where the page's own content begins (the node at which the pages'
titles stand as headlines), where it ends (the node that closes the element around the headline), which
nodes are constant and which slots only lead to other pages (all their text is links, or they end in a link
without words). A page's lines get their labels from the nodes they align with.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher
from itertools import chain
from zlib import crc32

import numpy as np

#: A text belongs to the frame if it stands on this share of the host's pages, with as many different page keys.
FRAME_SHARE, FRAME_KEYS = 0.04, 3
#: From this share of the pages on two keys are enough.
OFTEN = 0.25
#: A block's wrapper keeps the counts of texts on two of its pages and on this share of them. Of a host in several blocks of
#: hundreds of pages, texts on more than ``FRAME_SHARE + KEPT_SHARE`` of the pages are thus always found, and none below ``FRAME_SHARE``.
KEPT_SHARE = 0.01

#: A page of more runs of lines than this adds no nodes to the wrapper (its texts count, and its lines are aligned all the same);
#: streams whose lengths' product is larger than the second number are aligned greedily.
LONGEST_STREAM, LARGEST_TABLE = 2_000, 4_000_000

TAG = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9]*)([^<>]*)>")
ANY_TAG = re.compile(r"<[^<>]*>")
CLASS = re.compile(r"""(?:class|id)\s*=\s*["']?([^"'\s>]+)""", re.I)
SPACE = re.compile(r"\s+")
INLINE = {"a", "/a", "b", "/b", "i", "/i", "em", "/em", "strong", "/strong", "br", "span", "/span", "u", "/u"}
TITLE = re.compile(r"<title>(.*?)(?:</title>|\Z)", re.I)
COMMENT = re.compile(r"<!--.*?-->|<button\b.*?</button>")
LINK = re.compile(r"<a\b[^<>]*>(.*?)(?:</a>|\Z)", re.I)
WORDS = re.compile(r"\w")
END_MARKS = re.compile(r"[.!?]")
OPENER = re.compile(r"<(\w+)(?: [^<>]*)?>\Z")
#: Signs between the parts of a menu line; menus differ in them from page to page.
BETWEEN = re.compile(r"\s*[|·•]\s*")
PARTS = re.compile(r"\s*[|·•]\s*|\s{2,}")
#: Elements whose text is no text of the page.
UNSEEN = {"script", "style", "title", "form", "button"}


class Line:
    """One line of a body: its text, its token, and the mark-up facts the labels need."""

    __slots__ = ("raw", "text", "token", "hides", "_hash")

    def __init__(self, raw: str):
        self._hash = None
        self.raw = raw = raw.strip()
        if "<" not in raw:
            self.text = SPACE.sub(" ", html.unescape(raw) if "&" in raw else raw).strip()
            self.token = _plain_token(self.text)
            self.hides = ""
            return
        if "<!--" in raw or "<button" in raw:
            raw = COMMENT.sub("", raw)
        names = []
        for name, rest in TAG.findall(raw):
            name = name.lower()
            css = CLASS.search(rest) if rest else None
            if css:
                names.append(f"{name}.{css.group(1)}")
            elif name not in INLINE:
                names.append(name)
        text = ANY_TAG.sub("" if "</" not in raw else " ", raw) if "<br" not in raw else ANY_TAG.sub(" ", raw)
        if "&" in text:
            text = html.unescape(text)
        self.text = SPACE.sub(" ", text).strip()
        self.token = " ".join(names) + ("#" if self.text else "") + (_links(raw, self.text) if "<a" in raw else "")
        self.hides = _unseen(self.token)

    @property
    def hash(self) -> str:
        if self._hash is None:
            self._hash = text_hash(BETWEEN.sub(" ", self.text).rstrip(":"))
        return self._hash


def _links(raw: str, text: str) -> str:
    """``@`` if all words of the line are links, ``>`` if it ends in a link without words, else nothing."""
    links = [html.unescape(ANY_TAG.sub(" ", x)) for x in LINK.findall(raw)]
    if not links:
        return ""
    if not WORDS.search(links[-1]) and not END_MARKS.search(links[-1]) and ANY_TAG.sub(" ", raw[raw.lower().rfind("</a>") + 4 :]).strip() == "":
        return ">"
    return "@" if sum(len(WORDS.findall(x)) for x in links) >= len(WORDS.findall(text)) else ""


def _plain_token(text: str) -> str:
    if not text:
        return ""
    if text[-1] in ".!?…»”\"":
        return "T..." if text.endswith("...") or text.endswith("…") else "T."
    if " > " in text or " » " in text:
        return "T>"
    if text[-1] == ">":
        return "T@"
    return "T:" if text[-1] == ":" else "T%" if text[-1].isdigit() or text[-1] in "%)" else "T"


def parse(body: str) -> list[Line]:
    """Lines of a body split at newlines, empty ones included."""
    if len(_lines) > 60_000:
        _lines.clear()
    out = []
    for raw in body.split("\n"):
        line = _lines.get(raw)
        if line is None:
            line = Line(raw)
            if len(raw) < 300:
                _lines[raw] = line
        out.append(line)
    return out


#: Lines met before; those of the frames come again on every page of a host.
_lines: dict[str, Line] = {}


def text_hash(text: str) -> str:
    return format(crc32(text.encode("utf-8", "surrogatepass")), "x")


def page_title(body: str) -> str:
    """The page's title without the host's name, empty if it has none."""
    found = TITLE.search(body)
    if not found:
        return ""
    title = Line(found.group(1)).text
    return title.rpartition(" - ")[0] or title


_MINIMA = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], dtype=np.uint64)
_LOW = np.uint64(0xFFFFFFFF)
#: Lines of this length speak for a page; shorter ones only where it has none.
LONG = 60


_crc: dict[str, int] = {}


def page_key(lines: list[Line]) -> list[int]:
    """Six minima of hashed word triples: near copies of a page agree in one of them almost surely, different pages hardly ever."""
    words = " ".join(x.text for x in lines if len(x.text) >= LONG and "@" not in x.token).split()
    if len(words) < 3:
        words = " ".join(x.text for x in lines if "@" not in x.token).split()
    if len(_crc) > 300_000:
        _crc.clear()
    try:
        h = np.array([_crc[w] for w in words], dtype=np.uint64)
    except KeyError:
        for w in words:
            if w not in _crc:
                _crc[w] = crc32(w.encode("utf-8", "surrogatepass"))
        h = np.array([_crc[w] for w in words], dtype=np.uint64)
    if len(h) < 3:
        h = np.resize(h if len(h) else np.zeros(1, dtype=np.uint64), 3)
    triple = (h[:-2] * np.uint64(31) + h[1:-1] * np.uint64(1009) + h[2:] * np.uint64(50021)) & _LOW
    return (((triple[None, :] ^ (triple[None, :] >> np.uint64(15))) * _MINIMA[:, None]) & _LOW).min(axis=1).tolist()


class Texts:
    """On how many pages each text stands, with up to ``FRAME_KEYS`` page keys that have nothing in common."""

    def __init__(self) -> None:
        self.seen: dict[str, list] = {}

    def add(self, text: str, count: int, keys: list[list[int]]) -> None:
        known = self.seen.get(text)
        if known is None:
            self.seen[text] = [count, list(keys[:FRAME_KEYS])]
            return
        known[0] += count
        if len(known[1]) < FRAME_KEYS:
            for key in keys:
                if len(known[1]) < FRAME_KEYS and not any(a == b for other in known[1] for a, b in zip(key, other)):
                    known[1].append(key)

    def constant(self, pages: int, share: float) -> set[str]:
        """Texts on ``share`` of the pages, with page keys enough."""
        least = max(2, share * pages)
        return {t for t, (count, keys) in self.seen.items() if count >= least and (len(keys) >= FRAME_KEYS or len(keys) >= 2 and count >= OFTEN * pages)}


class Node:
    """``n`` pages have it, on ``runs`` of them it is repeated; on ``heads`` it holds the title as headline, on ``ends`` it closes the element around it."""

    __slots__ = ("token", "n", "runs", "mass", "heads", "ends")

    def __init__(self, token: str, n: int = 0, runs: int = 0, mass: int = 0, heads: int = 0, ends: int = 0):
        self.token, self.n, self.runs, self.mass, self.heads, self.ends = token, n, runs, mass, heads, ends

    def row(self) -> list:
        return [self.token, self.n, self.runs, self.mass, self.heads, self.ends]


class Page:
    """A parsed page: its lines, its token stream (runs of lines with the same token), headline and closing line by its own mark-up."""

    __slots__ = ("body", "lines", "marked", "key", "head", "close", "runs", "tokens", "by")

    def __init__(self, body: str):
        self.body, self.lines, self.marked = body, parse(body), "<" in body
        self.key = page_key(self.lines)
        self.head = self.close = self.by = None
        title = page_title(body) if self.marked else ""
        if title:
            self.head = next((k for k, x in enumerate(self.lines) if x.text == title and not x.hides and x.token[-1:] not in "@>"), None)
        if self.head is not None:
            self.close = closing_line(self.lines, self.head)

    def stream(self, constant: set[str]) -> tuple[str, ...]:
        """Tokens of the page; a text among ``constant`` is a token of its own. ``runs`` has each token's lines."""
        tokens: list[str] = []
        self.runs: list[list[int]] = []
        unseen = ""
        for k, line in enumerate(self.lines):
            token = line.token
            if not token:
                continue
            if unseen or line.hides:  # scripts and styles over several lines are one token
                unseen = unseen or line.hides
                if f"/{unseen}" in token or unseen == "title":
                    unseen = ""
                token = "unseen"
            elif is_constant(line, constant):
                token = f"={line.hash}"
            elif self.marked and token[0] == "T":  # wrapped lines of a page with mark-up are one run of text
                token = "T"
            if tokens and tokens[-1] == token:
                self.runs[-1].append(k)
            else:
                tokens.append(token)
                self.runs.append([k])
        self.tokens = tuple(tokens)
        return self.tokens


def _unseen(token: str) -> str:
    """The element that hides this line's text, if any."""
    name = token.split(" ", 1)[0].split(".", 1)[0].rstrip("#@>")
    return name if name in UNSEEN else ""


def closing_line(lines: list[Line], head: int) -> int | None:
    """The line that closes the element in which the headline stands."""
    for k in range(head - 1, -1, -1):
        raw = lines[k].raw
        if raw.startswith("<!--") or not raw:
            continue
        opened = OPENER.match(raw)
        if opened:
            closer = f"</{opened.group(1)}>".lower()
            return next((j for j in range(head + 1, len(lines)) if lines[j].raw.lower() == closer), None)
        return None
    return None


def is_constant(line: Line, constant: set[str]) -> bool:
    """Whether a line is one of the constant texts, or a row of menu entries that are."""
    if not line.text:
        return False
    if line.hash in constant:
        return True
    if line.token[0] != "T":
        return False
    parts = [p for p in PARTS.split(line.raw) if p]
    return len(parts) > 1 and sum(text_hash(p) in constant for p in parts) * 2 > len(parts)


class Wrapper:
    def __init__(self) -> None:
        self.pages = 0
        self.texts = Texts()
        self.nodes: list[Node] = []
        self._known: dict[tuple[str, ...], list[Node]] = {}

    @classmethod
    def of(cls, pages: list[Page]) -> "Wrapper":
        """The wrapper of a block of pages: count their texts, then align them one by one."""
        out = cls()
        out.pages = len(pages)
        hashes = [{x.hash for x in page.lines if x.text} for page in pages]
        counts = Counter(chain.from_iterable(hashes))
        kept = {t for t, n in counts.items() if n >= max(2, KEPT_SHARE * out.pages)}
        for page, found in zip(pages, hashes):
            for text in found & kept:
                out.texts.add(text, 1, [page.key])
        constant = out.texts.constant(out.pages, FRAME_SHARE)
        rare = _rare_classes(pages)
        for page in pages:
            out._fold(page, constant, rare)
        return out

    def _fold(self, page: Page, constant: set[str], rare: set[str]) -> None:
        tokens = page.stream(constant)
        if rare:
            tokens = page.tokens = tuple(_general(t) if t in rare else t for t in tokens)
        page.by = self
        for node, run in zip(self.align(tokens, grow=len(tokens) <= LONGEST_STREAM), page.runs):
            if node is None:
                continue
            node.n += 1
            node.runs += len(run) > 1
            node.heads += page.head in run
            node.ends += page.close in run
            if node.token[0] != "=":
                node.mass += sum(len(page.lines[k].text) for k in run)

    def merge(self, other: "Wrapper") -> None:
        """Fold another wrapper of the same host in."""
        self._known.clear()
        self.pages += other.pages
        for text, (count, keys) in other.texts.seen.items():
            self.texts.add(text, count, keys)
        for node, theirs in zip(self.align(tuple(n.token for n in other.nodes)), other.nodes):
            node.n += theirs.n
            node.runs += theirs.runs
            node.mass += theirs.mass
            node.heads += theirs.heads
            node.ends += theirs.ends

    def align(self, tokens: tuple[str, ...], grow: bool = True) -> list[Node | None]:
        """The node of each token; tokens that don't align get new optional nodes in place (None if it mustn't grow)."""
        known = self._known.get(tokens)
        if known is not None:
            return known
        own = [n.token for n in self.nodes]
        low, high = 0, 0
        short = min(len(own), len(tokens))
        while low < short and own[low] == tokens[low]:
            low += 1
        while high < short - low and own[-1 - high] == tokens[-1 - high]:
            high += 1
        out: list[Node | None] = list(self.nodes[:low])
        merged = list(self.nodes[:low])
        middle = self.nodes[low : len(own) - high]
        for kind, a, b, c, d in _differences(own[low : len(own) - high], tokens[low : len(tokens) - high]):
            merged += middle[a:b]
            if kind == "equal":
                out += middle[a:b]
            elif grow:
                fresh = [Node(t) for t in tokens[low + c : low + d]]
                out += fresh
                merged += fresh
            else:
                out += [None] * (d - c)
        tail = self.nodes[len(own) - high :]
        out += tail
        merged += tail
        if grow:
            self.nodes = merged
        if len(self._known) < 10_000:
            self._known[tokens] = out
        return out

    def dumps(self) -> str:
        return json.dumps([self.pages, self.texts.seen, [n.row() for n in self.nodes]], separators=(",", ":"))

    @classmethod
    def loads(cls, data: str) -> "Wrapper":
        out = cls()
        out.pages, out.texts.seen, nodes = json.loads(data)
        out.nodes = [Node(*n) for n in nodes]
        return out


def _differences(nodes: list[str], tokens: tuple[str, ...]) -> list[tuple[str, int, int, int, int]]:
    """Edit steps from nodes to tokens, as of ``SequenceMatcher``; very long streams are matched greedily in linear time."""
    if len(nodes) * len(tokens) <= LARGEST_TABLE:
        return SequenceMatcher(None, nodes, tokens, autojunk=False).get_opcodes()
    places: dict[str, list[int]] = {}
    for k, token in enumerate(nodes):
        places.setdefault(token, []).append(k)
    out, a, c = [], 0, 0
    for d, token in enumerate(tokens):
        found = places.get(token, ())
        k = bisect_left(found, a)
        if k < len(found):
            b = found[k]
            if b > a or d > c:
                out.append(("replace", a, b, c, d))
            out.append(("equal", b, b + 1, d, d + 1))
            a, c = b + 1, d + 1
    out.append(("replace", a, len(nodes), c, len(tokens)))
    return out


def _rare_classes(pages: list[Page]) -> set[str]:
    """Tokens with a class that a single page of the block has: the class tells nothing."""
    found: dict[str, int] = {}
    for k, page in enumerate(pages):
        for line in page.lines:
            if "." in line.token and line.token[0] != "T":
                known = found.get(line.token)
                found[line.token] = k if known is None or known == k else -1
    return {t for t, k in found.items() if k >= 0}


def _general(token: str) -> str:
    return " ".join(x.split(".", 1)[0] if "." in x else x for x in token.split(" "))


FRAME, LEADS, TEXT = 0, 1, 2


class Layout:
    """Labels of a page's lines by a finished wrapper."""

    def __init__(self, wrapper: Wrapper):
        self.wrapper = wrapper
        self.constant = wrapper.texts.constant(wrapper.pages, FRAME_SHARE)
        at = {id(n): k for k, n in enumerate(wrapper.nodes)}
        self.at = at
        heads = sum(n.heads for n in wrapper.nodes)
        ends = sum(n.ends for n in wrapper.nodes)
        self.heads = {k for k, n in enumerate(wrapper.nodes) if n.heads * 10 >= heads > 0 and n.heads > 0}
        self.ends = {k for k, n in enumerate(wrapper.nodes) if n.ends * 10 >= ends > 0 and n.ends > 0}
        self.head_tokens = {wrapper.nodes[k].token for k in self.heads}
        self.last = max(self.ends, default=len(wrapper.nodes))
        most = max((n.mass for n in wrapper.nodes if n.token == "T."), default=0)
        # the first of the slots that hold the plain pages' text
        self.main = next((k for k, n in enumerate(wrapper.nodes) if n.token == "T." and n.mass * 4 >= most), len(wrapper.nodes))

    def label(self, page: Page) -> list[tuple[int, int]]:
        """(line, TEXT) of the lines of the page's own content, the headline first, and (line, LEADS) of the links among them."""
        # a page that was folded into this very wrapper keeps its tokens and its alignment
        tokens = page.tokens if page.by is self.wrapper else page.stream(self.constant)
        nodes = [self.at.get(id(n), -1) if n else -1 for n in self.wrapper.align(tokens, grow=False)]
        found = self._marked(page, nodes) if page.marked else []
        return found or self._plain(page, nodes)

    def _marked(self, page: Page, nodes: list[int]) -> list[tuple[int, int]]:
        start = page.head
        if start is None:  # no headline by the title: the line at the headline's node, or one like it
            start = next((run[0] for run, k in zip(page.runs, nodes) if k in self.heads), None)
        if start is None:
            start = next((run[0] for run, token in zip(page.runs, page.tokens) if token in self.head_tokens), None)
        if start is None:  # a fragment begins with its headline
            start = next((run[0] for run, token in zip(page.runs, page.tokens) if token[0] not in "=T" and token[-1] == "#"), None)
            if start is None or start != page.runs[0][0]:
                return []
        close = page.close if start == page.head else closing_line(page.lines, start)
        unclosed = close is None and page.head is not None
        out, inside = [], False
        for run, token, k in zip(page.runs, page.tokens, nodes):
            if run[-1] < start:
                continue
            if inside and (close is not None and run[0] <= close <= run[-1] or k in self.ends or unclosed and k > self.last):
                break
            inside = True
            for line in run:
                if line < start or not page.lines[line].text:
                    continue
                if line == start or token != "unseen" and token[0] != "=":
                    out.append((line, LEADS if token[-1] in "@>" and line != start else TEXT))
        return out

    def _plain(self, page: Page, nodes: list[int]) -> list[tuple[int, int]]:
        first, seen_main = -1, False  # the page's last line that the host's pages have before their text
        for run, token, k in zip(page.runs, page.tokens, nodes):
            seen_main |= k == self.main
            if token == "T>" or token[0] == "=" and (k < self.main if k >= 0 else not seen_main):
                first = run[-1]
        out, before = [], ""
        for run, token, k in zip(page.runs, page.tokens, nodes):
            alone = token == "T%" and len(run) == 1 and before == "T." and out and (k < 0 or self.wrapper.nodes[k].runs < self.wrapper.nodes[k].n)
            leads = token == "T..." and before[:1] == "=" or token in ("T@", "T>") or alone
            before = token
            if not (leads or token[0] == "=" or token == "unseen"):
                out += [(line, TEXT) for line in run if page.lines[line].text and line > first]
        return out
