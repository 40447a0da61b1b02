"""Problem 7: text decoded with the wrong character encoding.

1. Multibyte damage (UTF-8 read in a single-byte encoding): characters are mapped back to the bytes of
   each legacy encoding, and an automaton over the byte classes (lead of 2, 3 or 4, continuation) finds
   the maximal well-formed multibyte spans; only those spans are decoded, over and over while damage
   of a second or third pass remains. A replacement character counts as a continuation byte that is lost.
2. Single-byte damage (one legacy encoding read as another) has no byte structure, so the method can't
   show it. There lines with unlikely characters or letter case are read back through every pair of
   encodings, and the reading whose letters are the most likely by the letter frequencies of the
   Cyrillic languages is taken if it is clearly better.
3. Replacement characters that remain can't be restored; the row is reported all the same.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.tables import spread, table

#: Encodings that UTF-8 is taken for by mistake.
WRONG_FOR_UTF8 = ("cp1252", "cp1251", "mac_roman", "cp1250", "cp866", "koi8_r", "iso8859_5", "mac_cyrillic", "cp437", "cp850")
SINGLE_BYTE = ("cp1251", "koi8_u", "cp866", "cp1252", "iso8859_5", "mac_cyrillic", "mac_roman")


@lru_cache(None)
def _char_of(codec: str) -> tuple[str, ...]:
    """Character of each byte from 0x80; undefined bytes are read as the control characters of Latin-1."""
    return tuple(bytes([b]).decode(codec, "ignore") or chr(b) for b in range(128, 256))


def _class(chars) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(set(chars))) + "]"


@lru_cache(None)
def _automaton(codec: str) -> tuple[re.Pattern, dict[str, int]]:
    """The byte-structure automaton written over the codec's characters, and the byte of each character."""
    chars = _char_of(codec)
    byte = {c: b + 128 for b, c in enumerate(chars)}
    if codec == "cp1252":  # Latin-1 readings leave control characters in place of the signs
        byte.update({chr(b): b for b in range(128, 160)})
    group = lambda lo, hi: [c for c, b in byte.items() if lo <= b <= hi]
    follow = _class([*group(0x80, 0xBF), "�"])
    lead2, lead3, lead4 = _class(group(0xC2, 0xDF)), _class(group(0xE0, 0xEF)), _class(group(0xF0, 0xF4))
    return re.compile(f"(?:{lead2}{follow}|{lead3}{follow}{{2}}|{lead4}{follow}{{3}})+"), byte


#: Signs that a decoded span may hold besides letters.
SIGNS = frozenset("«»“”„‘’–—…·•№°©®§±×÷¡¿€™ªº´¨¸£¤¥¦¬¢¹²³¼½¾µ¶\xa0\xad→←≤≥")


def _plausible(text: str) -> bool:
    for c in text:
        o = ord(c)
        if not (0xC0 <= o <= 0x17F or 0x400 <= o <= 0x45F or c in "ґҐ" or c in SIGNS or c == "�" or 0x20AC == o or 0x80 <= o <= 0x9F or 0x2C6 <= o <= 0x2DC or 0x2020 <= o <= 0x203A or 0x192 == o or 0x2200 <= o <= 0x22FF or 0x2500 <= o <= 0x25FF):
            return False
    return True


def decode_spans(line: str) -> tuple[str, bool]:
    """The line with its maximal well-formed spans decoded, by the codec whose spans cover most of it, until none is left."""
    hit = False
    while True:  # each pass makes the line shorter
        present = set(line)
        best, chosen = 0, None
        for codec in WRONG_FOR_UTF8:
            if not present & _leads(codec):
                continue
            new, covered = _decode(line, codec)
            if covered > best:
                best, chosen, used = covered, new, codec
        if chosen is None:
            break
        # in a line shown to be damaged, lone sequences of the same codec are damage too
        line, hit = _decode(chosen, used, strict=False)[0] if best >= 6 else chosen, True
    return line, hit


def _decode(line: str, codec: str, strict: bool = True) -> tuple[str, int]:
    pattern, byte = _automaton(codec)
    covered = 0

    def replace(m: re.Match) -> str:
        nonlocal covered
        span = m.group()
        if "�" in span:
            decoded = _lossy(span, byte)
        else:
            decoded = bytes(map(byte.__getitem__, span)).decode("utf-8", "replace")
        if not _plausible(decoded) or "�" in decoded and "�" not in span:
            return span
        if len(decoded) == 1 and (strict or span[1] == "…") and not _single(span, decoded, codec, line[m.start() - 1 : m.start()], line[m.end() : m.end() + 1]):
            return span
        if strict and len(decoded) == 2 and codec != "cp1252" and all(c.isalpha() for c in span):
            return span  # two ordinary letters, such as Ukrainian capitals before i
        covered += len(span)
        return decoded

    return pattern.sub(replace, line), covered


@lru_cache(None)
def _leads(codec: str) -> frozenset[str]:
    return frozenset(c for c, b in _automaton(codec)[1].items() if 0xC2 <= b <= 0xF4)


def _single(span: str, decoded: str, codec: str, before: str, after: str) -> bool:
    """Whether a lone sequence is damage: a sign, or a Latin letter inside a word, or a Cyrillic letter where the codec has none of its own."""
    if codec not in ("cp1252", "cp1250", "cp1251", "cp866", "koi8_r", "mac_roman"):
        return False
    if codec == "mac_roman" and any("Ѐ" < c < "ӿ" or c in "®©¬" for c in before + after):
        return False
    if decoded in SIGNS or decoded == "�":
        return len(span) == 3 or not span[1].isalpha() and span[1] not in "»”“…" or span[0] in "ÃÂ┬"
    if 0xC0 <= ord(decoded) <= 0x17F:
        near = (before + after).strip()
        return span[0] == "Ã" or bool(near) and near.isascii() and near.isalpha()
    return 0x400 <= ord(decoded) <= 0x491 and codec not in ("cp1251", "mac_roman", "cp1250") and not (span[1].isalpha() and span[0].isalpha() and codec != "cp1252")


def _lossy(span: str, byte: dict[str, int]) -> str:
    out, at = [], 0
    while at < len(span):
        lead = byte[span[at]]
        n = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        part = span[at : at + n]
        out.append("�" if "�" in part else bytes(map(byte.__getitem__, part)).decode("utf-8", "replace"))
        at += n
    return "".join(out)


#: Letters per thousand in Russian prose, with the further Ukrainian letters.
_PER_MILLE = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъёіїєґ", (109, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 0.4, 4, 20, 3, 3, 0.3)))
_LOG = {c: math.log(n / 1000) for c, n in _PER_MILLE.items()}
_STRANGE = -9.0
_NEUTRAL = frozenset("«»“”„‘’–—…·•№°©\xa0€→")
#: Characters of correct text in the languages at hand; anything else is looked at closely.
SAFE = frozenset(map(chr, range(128))) | frozenset("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯІЇЄҐ áéíóúñüäößçèêàâôîûœùëïÁÉÍÓÚÑÜÄÖÇÈÊÀÂÔŒÎ «»“”„‘’–—…·•№°©¡¿→€")
_CYRILLIC = frozenset("абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
_SWAPPED = re.compile("(?<=[а-яё])[А-ЯЁ]{2}")
_MIXED = re.compile("(?<=[a-z])[а-яёА-ЯЁ]|[а-яёА-ЯЁ](?=[a-z])")
_ACCENTS = re.compile("[À-ÿ]{3}")


def suspicious(text: str) -> bool:
    """Whether anything in the text asks for a closer look; cheap, as nearly all texts end here."""
    chars = set(text)
    if not chars <= SAFE or _SWAPPED.search(text):
        return True
    if 0 < len(chars & _CYRILLIC) < 20 and _MIXED.search(text):
        return True
    return bool(_ACCENTS.search(text)) if "î" in chars or "ï" in chars or "è" in chars or "à" in chars else False


def likelihood(text: str) -> tuple[float, int]:
    """(mean log frequency of the non-ASCII characters as Cyrillic text, how many)."""
    total, n = 0.0, 0
    before = " "
    for c in text:
        if c > "\x7f" and c not in _NEUTRAL:
            low = c.lower()
            total += _LOG.get(low, _STRANGE)
            if c != low and before.islower():
                total -= 4.0
            n += 1
        before = c
    return (total / n if n else 0.0), n


@lru_cache(None)
def _table(read_as: str, really: str) -> dict[int, str]:
    """Characters of the wrong reading to those of the right one."""
    return {ord(w): r for w, r in zip(_char_of(read_as), _char_of(really)) if w != r}


_LATIN = frozenset("áéíóúñüäößçèêàâôîûœùëïÁÉÍÓÚÑÜÄÖÇÈÊÀÂÔ¡¿«»“”„–—…’°")


def _latin_reading(line: str) -> str | None:
    """A line of Latin script whose accented letters were read in another single-byte encoding."""
    plain = ANY_TAG.sub(" ", line)
    odd = [c for c in plain if c > "\x7f"]
    if len(odd) * 4 > len(plain) or not any(m not in _LATIN and m not in SIGNS for m in _INSIDE.findall(plain)):
        return None
    for wrong in ("cp1251", "koi8_u", "cp866", "mac_roman", "mac_cyrillic", "iso8859_5", "cp437", "cp850"):
        table = _table(wrong, "cp1252")
        if all(c.translate(table) in _LATIN for c in odd):
            return line.translate(table)
    return None


ANY_TAG = re.compile(r"<[^<>]*>|&\w+;")
#: A strange character within a word of Latin script, or a box sign where a Spanish mark opens a sentence.
_INSIDE = re.compile(r"(?<=[a-z])[^\x00-\x7f]|[─-╿░-▓Ё-я](?=[A-Z]?[a-z]{2})")
_TOUCHING = re.compile(r"[A-Za-z][^\x00-\x7f]|[^\x00-\x7f][A-Za-z]")
#: A reading must be this much likelier per character, and as likely as real text; short lines follow the page's other lines.
MARGIN, SWAPPED_MARGIN, REAL, SHORT = 1.0, 0.1, -4.4, 12
#: A longer line is judged in windows of this many characters, a new one at each half of it.
SAMPLE = 160
_WORD = re.compile(r"\S*\s*")


def _windows(line: str) -> list[str]:
    """Overlapping windows that cover the whole line; the line itself if it is short."""
    if len(line) <= SAMPLE:
        return [line]
    starts = range(0, len(line) - SAMPLE // 2, SAMPLE // 2)
    return [line[a : a + SAMPLE] for a in starts]


def _judge(window: str, here: float) -> tuple[dict, bool]:
    """(likelihood of each reading, whether the best of them is clearly likelier than the text as it is)."""
    swapped, scores = bool(_SWAPPED.search(window)), {}
    if here > -3.7 and not swapped:
        return scores, False
    for wrong in SINGLE_BYTE:
        for really in ("cp1251", "koi8_u", "cp866"):
            if wrong != really:
                scores[wrong, really] = likelihood(window.translate(_table(wrong, really)))[0]
    best = max(scores.values())
    return scores, best > here + (SWAPPED_MARGIN if swapped else MARGIN) and best > REAL


#: What a change between readings within a line costs, so that single words don't change sides by chance.
SWITCH = 8.0
#: What a capital within a word costs: a wrong reading often swaps the case.
CAPITALS = 0.5


def _sound(run: str) -> bool:
    """Whether a translated run is text; what is still damaged then was no single-byte damage."""
    signs = [c for c in run if c > "\x7f"]
    return likelihood(run)[0] > REAL and sum(c not in SAFE for c in signs) * 10 <= len(signs) and not decode_spans(run)[1]


def _mend(line: str, pairs: list[tuple[str, str]]) -> str:
    """A long line with its damaged runs of words translated: the likeliest sequence of readings, sound text being one of them."""
    tables = [{}] + [_table(*p) for p in pairs]
    best, paths = [0.0] * len(tables), []
    words = _WORD.findall(line)
    for word in words:
        read = [word.translate(t) if t else word for t in tables]
        judged = [(mean - CAPITALS * sum(map(str.isupper, w[1:])) / max(1, n), n) for w, (mean, n) in zip(read, map(likelihood, read))]
        most = max(n for _, n in judged)
        top = max(range(len(best)), key=best.__getitem__)
        come = [k if best[k] >= best[top] - SWITCH else top for k in range(len(best))]
        best = [best[c] - (SWITCH if c != k else 0.0) + mean * n + (most - n) * REAL for k, (c, (mean, n)) in enumerate(zip(come, judged))]
        paths.append(come)
    at, runs = max(range(len(best)), key=best.__getitem__), []
    for word, come in zip(reversed(words), reversed(paths)):
        if not runs or runs[-1][0] != at:
            runs.append((at, []))
        runs[-1][1].append(word)
        at = come[at]
    out = []
    for state, run in reversed(runs):
        old = "".join(reversed(run))
        changed = [new for word in reversed(run) if (new := word.translate(tables[state])) != word]
        out.append(old.translate(tables[state]) if changed and _sound("".join(changed)) else old)
    return "".join(out)


def read_back(lines: list[str]) -> bool:
    """Replace single-byte damage in ``lines`` in place; whether there was any.

    A line of at most ``SAMPLE`` characters has one reading. A longer one is judged window by window over its whole
    length, and only its damaged runs are translated.
    """
    found, maybe, votes = {}, {}, {}
    hit = False
    for k, line in enumerate(lines):
        if line.isascii():
            continue
        fixed = _latin_reading(line) if suspicious(line) else None
        if fixed is not None:
            lines[k], hit = fixed, True
            continue
        judged = False
        for window in _windows(line):
            here, n = likelihood(window)
            if n < 3 or len(_TOUCHING.findall(window)) * 4 > n:
                continue
            judged = True
            scores, clear = _judge(window, here)
            if clear:
                pair = max(scores, key=scores.__getitem__)
                found.setdefault(k, []).append((n, scores, here))
                votes[pair] = votes.get(pair, 0) + n
        if judged and k not in found:
            maybe[k] = likelihood(line)[0]
    if found:
        usual = max(votes, key=votes.__getitem__)
        for k, windows in found.items():
            pairs = []
            for n, scores, here in windows:
                pair = max(scores, key=scores.__getitem__)
                if n < SHORT and scores[usual] > here:
                    pair = usual
                if pair not in pairs:
                    pairs.append(pair)
            new = lines[k].translate(_table(*pairs[0])) if len(lines[k]) <= SAMPLE else _mend(lines[k], pairs)
            hit |= new != lines[k]
            lines[k] = new
        if len(found) >= len(maybe):  # the whole page: lines too short to tell follow the others
            for k, here in maybe.items():
                if len(lines[k]) > SAMPLE:
                    lines[k] = _mend(lines[k], [usual])
                    continue
                new = lines[k].translate(_table(*usual))
                if likelihood(new)[0] > here:
                    lines[k] = new
    return hit


def restore(body: str | None) -> tuple[str | None, bool]:
    """(restored text, whether anything was decoded wrongly). Null and ASCII texts come back as they are."""
    if not body or body.isascii() or not suspicious(body):
        return body, False
    affected = "�" in body
    lines = body.split("\n")
    for k, line in enumerate(lines):
        if not line.isascii() and not set(line) <= SAFE:
            new, hit = decode_spans(line)
            if hit:
                lines[k], affected = new, True
    affected |= read_back(lines)
    return ("\n".join(lines) if affected else body), affected


def repaired(df: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, restored string``: the rows of ``df`` whose text, or a part of it, was decoded wrongly.

    ``restored`` is the text as far as it can be restored; what was lost stays a replacement character.
    Null, empty and correct texts give no row; character entities and unusual names aren't damage.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = [], []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new, affected = restore(body)
                if affected:
                    keys.append(k)
                    texts.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(texts, pa.string())], names=[key, "restored"])

    return df.select(key, text).filter(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, restored string")


def p7_found(spark, sf_dir):
    return repaired(spread(table(spark, sf_dir, "crawl_document").select("rec_id", "body"), "rec_id"), "rec_id", "body").select("rec_id")


def p7_restored(spark, sf_dir):
    return repaired(spread(table(spark, sf_dir, "crawl_document").select("rec_id", "body"), "rec_id"), "rec_id", "body")


QUERIES = {"p7_found": p7_found, "p7_restored": p7_restored}
SQL: dict[str, str] = {}
