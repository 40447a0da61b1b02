"""Problem 4: keyword-stuffed and link-list pages.

The page's own content (problem 6's wrappers take the frame away) is measured in two ways. Clause structure:
the share of its words that stand in sentences of some length. Repetition: the suffix automaton of what isn't
clauses is built, and the characters are measured that repeated maximal substrings cover. The automaton reads
words and signs; a link to another host, and a tag (a name with a hash sign, or with its count), are one symbol
each whatever they name, with the characters they take, so lists of links and of tags are repetitions, too.
A page is a case if the covered share of its characters, weighted by the lack of clauses, is large.
"""

from __future__ import annotations

import html
import re

from tessera.llm.quality import SENTENCE_END
from tessera.llm.wrapper import ANY_TAG, Line

#: A repeat occurs at least so often and is at least so long; words of a sentence at least and at most.
MIN_COUNT, MIN_CHARS = 3, 4
CLAUSE_WORDS, LONGEST_CLAUSE = 4, 40
#: Words that a page must have to be told; share of words in clauses from which no page is a case; least coverage times lack of clauses.
MIN_WORDS, MOSTLY_CLAUSES, REPETITIVE = 12, 0.75, 0.29


class SuffixAutomaton:
    """Suffix automaton of a sequence with the end-position count of every state."""

    def __init__(self, items):
        self.link, self.length, self.next, self.count = [-1], [0], [{}], [0]
        link, length, following, count = self.link, self.length, self.next, self.count
        last = 0
        for item in items:
            cur = len(length)
            length.append(length[last] + 1)
            following.append({})
            link.append(0)
            count.append(1)
            p = last
            while p >= 0 and item not in following[p]:
                following[p][item] = cur
                p = link[p]
            if p >= 0:
                q = following[p][item]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    following.append(dict(following[q]))
                    link.append(link[q])
                    count.append(0)
                    while p >= 0 and following[p].get(item) == q:
                        following[p][item] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
            if link[state] > 0:
                count[link[state]] += count[state]

    def longest_repeat_ends(self, items, min_count: int) -> list[int]:
        """For each end position the length of the longest suffix there that occurs ``min_count`` times or more."""
        out, state = [], 0
        for item in items:
            state = self.next[state][item]
            up = state
            while up > 0 and self.count[up] < min_count:
                up = self.link[up]
            out.append(self.length[up] if up > 0 else 0)
        return out


WINDOW = 100_000
PIECE = re.compile(r"\w+|[^\w\s]")


def covered_share(pieces: list[str], sizes: list[int], min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> float:
    """Share of the characters that lie in a repeated substring of ``min_chars`` or more; 0 for nothing.

    Of contents longer than ``WINDOW`` symbols each stretch of that length has an automaton of its own, which bounds the memory.
    """
    total = sum(sizes)
    if not total:
        return 0.0
    return sum(_covered(pieces[at : at + WINDOW], sizes[at : at + WINDOW], min_chars, min_count) for at in range(0, len(pieces), WINDOW)) / total


def _covered(pieces: list[str], sizes: list[int], min_chars: int, min_count: int) -> int:
    """Characters that repeated substrings cover."""
    sums = [0]
    for n in sizes:
        sums.append(sums[-1] + n)
    ends = SuffixAutomaton(pieces).longest_repeat_ends(pieces, min_count)
    covered, low = 0, len(pieces)
    for at in range(len(pieces) - 1, -1, -1):
        begin = at - ends[at] + 1
        if ends[at] and sums[at + 1] - sums[begin] >= min_chars:
            low = min(low, begin)
        if at >= low:
            covered += sizes[at]
    return covered


def repeated_coverage(text: str, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> float:
    """Share of the visible characters of a text that repeated substrings cover."""
    pieces = PIECE.findall(text)
    return covered_share(pieces, list(map(len, pieces)), min_chars, min_count)


#: Stand-ins of a link to another host and of a tag.
LINKED, TAGGED = "\x01", "\x02"
OUTGOING = re.compile(r"""<a\b[^<>]*?href=["']?(https?://[^"'\s<>]*)[^<>]*>(.*?)(?:</a>|\Z)""", re.I)
TAG = re.compile(r"#\w[\w-]*|\b\w[\w-]*\s*\(\d+\)")
NAME = re.compile(r"[^\W\d_]{2,}")
ORDINAL = re.compile(r"^\s*(?:\d+[.)]|[-•*])\s+")
SYMBOL = re.compile(rf"{LINKED}|{TAGGED}|\w+|[^\w\s]")


def clauses(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of ``CLAUSE_WORDS`` words or more; of what precedes an end mark the last ``LONGEST_CLAUSE`` words at most."""
    out, at = [], 0
    for m in SENTENCE_END.finditer(text):
        begin, at = at, m.end()
        part = text[begin:at]
        if part.count(". ") * CLAUSE_WORDS > part.count(" "):  # single words with full stops
            continue
        words = part.rsplit(None, LONGEST_CLAUSE)
        begin += max(len(words[0]) if len(words) > LONGEST_CLAUSE else 0, part.rfind(LINKED) + 1, part.rfind(TAGGED) + 1)
        if len(text[begin:at].split(None, CLAUSE_WORDS)) >= CLAUSE_WORDS:
            out.append((begin, at))
    return out


def clause_share(text: str) -> float:
    words = len(text.split())
    return sum(len(text[a:b].split()) for a, b in clauses(text)) / max(1, words)


def repetition(raw: list[str]) -> float:
    """Share of the characters of content lines, clauses apart, that repeated substrings cover."""
    sizes: list[int] = []

    def link(m: re.Match) -> str:
        sizes.append(len(m.group(1)) + len(ANY_TAG.sub("", m.group(2))))
        return LINKED

    def tag(m: re.Match) -> str:
        marked.append(len(m.group()))
        return TAGGED

    marked: list[int] = []
    lines = [html.unescape(ANY_TAG.sub(" ", OUTGOING.sub(link, ORDINAL.sub("", x)))) for x in raw]
    text = TAG.sub(tag, "\n".join(" ".join(x.split()) for x in lines))
    pieces, lengths, at = [], [], 0
    linked, tagged = iter(sizes), iter(marked)
    for a, b in [*clauses(text), (len(text), len(text))]:
        for m in SYMBOL.finditer(text, at, a):
            piece = m.group()
            pieces.append(piece.lower())
            lengths.append(next(linked) if piece == LINKED else next(tagged) if piece == TAGGED else len(piece))
        pieces.append("\n")  # no repeat runs over a sentence
        lengths.append(0)
        for piece in text[a:b]:
            if piece == LINKED:
                next(linked)
            elif piece == TAGGED:
                next(tagged)
        at = b
    return covered_share(pieces, lengths)


def is_spam(lines: list[Line], content: list[int]) -> bool:
    """Whether the page's own content (its first line is the headline) is repeated keywords, lists of links or product tags."""
    if len(content) < 2:
        return False
    own = [lines[k] for k in content[1:]]
    text = "\n".join([x.text for x in own])
    if len(NAME.findall(text)) < MIN_WORDS:
        return False
    share = clause_share(text)
    if share > MOSTLY_CLAUSES:
        return False
    return repetition([x.raw for x in own]) * (1 - share) >= REPETITIVE


def p4_rows(rec_id, url, page, labels):
    return [(rec_id,)] if is_spam(page.lines, [k for k, _ in labels]) else []


def keyword_pages(df):
    """``rec_id`` of the spam pages of ``df`` (rec_id, url, site, body); null and blank bodies are none."""
    from tessera.llm.pages import with_layouts

    return with_layouts(df, p4_rows, ["rec_id"])


def p4_found(spark, sf_dir):
    from tessera.tables import table

    return keyword_pages(table(spark, sf_dir, "crawl_document"))


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
