"""Column functions on text: tokenising, n-grams, HTML to text, layout repair, year and position features.

All are built-in expressions inside whole-stage plans; what Spark lacks (stemming, MurmurHash3, zlib)
is an Arrow UDF. Null in, null out; an empty text gives an empty array.
"""

from __future__ import annotations

import html.parser
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]+"
ALNUM = r"[\p{L}\p{N}]+"
LETTERS = r"[\p{L}_]+"


def tokens(col, pattern: str = WORD, lower: bool = True) -> Column:
    """All matches of ``pattern`` in order, of the lower-cased text by default."""
    col = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(col) if lower else col, F.lit(f"({pattern})"), F.lit(1))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: an expression that a lambda refers to is computed anew in each of its steps otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bigrams(words: Column) -> Column:
    """Neighbouring pairs joined by a blank."""

    def pairs(w: Column) -> Column:
        rest = F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))
        return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), rest, lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.when(w.isNotNull(), F.array().cast("array<string>")))

    return let(words, pairs)


def windows(words: Column, width: int, include_last: bool = True, separator: str = " ") -> Column:
    """All runs of ``width`` words; ``include_last=False`` drops the last run, as the shingle definition does."""

    def runs(w: Column) -> Column:
        n = F.size(w) - width + (1 if include_last else 0)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i + 1, width), separator))).otherwise(F.when(w.isNotNull(), F.array().cast("array<string>")))

    return let(words, runs)


def chunks(words: Column, width: int = 7) -> Column:
    """Successive groups of ``width`` words; the last one may be shorter."""

    def groups(w: Column) -> Column:
        n = F.ceil(F.size(w) / width).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * width + 1, width), " "))).otherwise(F.when(w.isNotNull(), F.array().cast("array<string>")))

    return let(words, groups)


#: The keys of the two keyboard layouts in the same places.
EN_KEYS = "qwertyuiop[]asdfghjkl;'zxcvbnm,."
RU_KEYS = "йцукенгшщзхъфывапролджэячсмитьбю"


def repair_layout(col, wrong_is_latin: bool = True) -> Column:
    """Text typed in the wrong keyboard layout; characters without a partner stay."""
    return F.translate(F.lower(F.col(col)), EN_KEYS, RU_KEYS) if wrong_is_latin else F.translate(F.lower(F.col(col)), RU_KEYS, EN_KEYS)


HTML_STEPS = (
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<script\b.*?</script>", " "),
    (r"(?is)<style\b.*?</style>", " "),
    (r"(?is)<head\b.*?</head>", " "),
    (r"(?is)<title\b.*?</title>", " "),
    (r"(?s)<[^<>]*>", " "),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"[ \t\r\n]+", " "),
)


def visible_text(col, keep_head: bool = False) -> Column:
    """Visible text of a page: comments, script, style and (by default) head and title go, tags become blanks."""
    out = F.col(col) if isinstance(col, str) else col
    for pattern, by in HTML_STEPS:
        if not (keep_head and ("head" in pattern or "title" in pattern)):
            out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def visible_text_sql(col: str, keep_head: bool = False) -> str:
    out = col
    for pattern, by in HTML_STEPS:
        if keep_head and ("head" in pattern or "title" in pattern):
            continue
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"trim({out})"


class _Streaming(html.parser.HTMLParser):
    """Text with line breaks: p gives a blank line, br a break, a closed br a blank line; script and style text stays."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_data(self, data):
        data = re.sub(r"[ \t\r\n]+", " ", data.strip())
        if data:
            self.out.append(data + " ")

    def handle_starttag(self, tag, attrs):
        self.out.append({"p": "\n\n", "br": "\n"}.get(tag, ""))

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.out.append("\n\n")


@F.pandas_udf(T.StringType())
def streamed_text(pages: pd.Series) -> pd.Series:
    """Text of HTML by a streaming parser; unclosed mark-up is taken as it is."""

    def one(page):
        if page is None:
            return None
        parser = _Streaming()
        parser.feed(page)
        parser.close()
        return "".join(parser.out).strip()

    return pages.map(one)


@F.pandas_udf(T.DoubleType())
def zip_ratio(texts: pd.Series) -> pd.Series:
    """Length of the text in UTF-8 over its zlib length at level 9; null for null, 0 for empty."""
    return texts.map(lambda t: None if t is None else round(len(b) / len(zlib.compress(b, 9)), 6) if (b := t.encode("utf-8", "replace")) else 0.0)


@F.pandas_udf(T.IntegerType())
def murmur3(words: pd.Series) -> pd.Series:
    """MurmurHash3 x86 32-bit, seed 0, signed, of the UTF-8 bytes; words of the same length are hashed together."""
    data = [w.encode("utf-8") if w is not None else None for w in words]
    out = np.zeros(len(data), dtype=np.int64)
    lengths = np.array([-1 if b is None else len(b) for b in data])
    for length in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == length)
        raw = np.frombuffer(b"".join(data[k] for k in rows), dtype=np.uint8).reshape(len(rows), length)
        out[rows] = _murmur3_rows(raw)
    return pd.Series(out, dtype="Int32").mask(pd.Series(lengths < 0))


def _murmur3_rows(raw: np.ndarray) -> np.ndarray:
    """Signed hash of each row of bytes."""
    n, length = raw.shape
    low = np.uint64(0xFFFFFFFF)
    turn = lambda x, k: ((x << np.uint64(k)) | (x >> np.uint64(32 - k))) & low
    scramble = lambda k: (turn((k * np.uint64(0xCC9E2D51)) & low, 15) * np.uint64(0x1B873593)) & low
    h = np.zeros(n, dtype=np.uint64)
    whole = length // 4 * 4
    for at in range(0, length, 4):
        part = raw[:, at : min(at + 4, length)].astype(np.uint64)
        k = sum(part[:, j] << np.uint64(8 * j) for j in range(part.shape[1]))
        h ^= scramble(k)
        if at < whole:
            h = (turn(h, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & low
    h ^= np.uint64(length)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & low
    return (h ^ (h >> np.uint64(16))).astype(np.uint32).view(np.int32).astype(np.int64)


def murmur3_32(data: bytes, seed: int = 0) -> int:
    mask, h = 0xFFFFFFFF, seed

    def scramble(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        return (k << 15 | k >> 17) * 0x1B873593 & mask

    whole = len(data) // 4 * 4
    for at in range(0, whole, 4):
        h ^= scramble(int.from_bytes(data[at : at + 4], "little"))
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & mask
    if whole < len(data):
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def md5_hash(col: Column) -> Column:
    """Unsigned 32-bit hash that SQL engines can reproduce: the first eight hex digits of md5."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("bigint")


#: Frequent words by language, for the fallback language guess.
STOP_WORDS = {
    "en": "the a of and to in is that it for with as on every this",
    "ru": "и в не на что с по а но как из у за от для до без около",
    "uk": "і й та не на що з по а але як із у за від для до без навколо",
    "de": "der die das und in den von zu mit dem ein eine ist nicht hinter",
    "fr": "le la les et de des un une du dans pour avec sur est sous",
    "es": "el la los y de que un una en con por para del sin sobre",
}


def guess_language(words: Column, fallback: str = "ru") -> Column:
    """Language whose stop words make up the most tokens; ``fallback`` where none occurs. Ties go to the first listed."""

    def best(w: Column) -> Column:
        scores = [F.size(F.filter(w, lambda x: x.isin(stop.split()))) for stop in STOP_WORDS.values()]
        top = F.greatest(*scores)
        out = F.when(w.isNull() | (top == 0), F.lit(fallback))
        for lang, score in zip(STOP_WORDS, scores):
            out = out.when(score == top, F.lit(lang))
        return out

    return let(words, best)


_STEPS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
_STEP2 = dict(
    zip(
        "ational tional enci anci izer abli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti".split(),
        "ate tion ence ance ize able al ent e ous ize ate ate al ive ful ous al ive ble".split(),
    )
)
_STEP3 = dict(zip("icate ative alize iciti ical ful ness".split(), ("ic", "", "al", "ic", "ic", "", "")))
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _measure(stem: str) -> int:
    kinds = re.sub(r"(.)\1*", r"\1", "".join("v" if _vowel(stem, k) else "c" for k in range(len(stem))))
    return kinds.count("vc")


def _vowel(word: str, k: int) -> bool:
    return word[k] in "aeiou" or word[k] == "y" and k > 0 and not _vowel(word, k - 1)


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, k) for k in range(len(stem)))


def _cvc(word: str) -> bool:
    return len(word) > 2 and not _vowel(word, len(word) - 1) and _vowel(word, len(word) - 2) and not _vowel(word, len(word) - 3) and word[-1] not in "wxy"


def porter(word: str) -> str:
    """Porter's stemmer for English words in lower case."""
    if len(word) < 3 or not word.isascii():
        return word
    for end, by in _STEPS:
        if word.endswith(end):
            word = word[: len(word) - len(end)] + by
            break
    again = False
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and _has_vowel(word[:-2]):
        word, again = word[:-2], True
    elif word.endswith("ing") and _has_vowel(word[:-3]):
        word, again = word[:-3], True
    if again:
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and not _vowel(word, len(word) - 1) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _cvc(word):
            word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        end = max((e for e in rules if word.endswith(e)), key=len, default=None)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + rules[end]
    end = max((e for e in _STEP4 if word.endswith(e)), key=len, default=None)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _cvc(word[:-1])):
        word = word[:-1]
    if _measure(word) > 1 and word.endswith("ll"):
        word = word[:-1]
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series, langs: pd.Series) -> pd.Series:
    """English tokens by Porter's stemmer, others unchanged; the memo is keyed by language and token."""
    memo: dict[tuple, str] = {}

    def one(found, lang):
        if found is None:
            return None
        out = []
        for w in found:
            if lang == "en" and not w[:1].isdigit():
                if (lang, w) not in memo:
                    memo[lang, w] = porter(w)
                w = memo[lang, w]
            out.append(w)
        return out

    return pd.Series([one(w, lang) for w, lang in zip(words, langs)])


def lemmas(tokens_df, lemma_table, lang: str = "lang", token: str = "token"):
    """Lemma hook: tokens joined with a table (lang, token, lemma); unknown tokens stay."""
    known = lemma_table.select(lang, token, "lemma").dropDuplicates([lang, token])
    return tokens_df.join(known, [lang, token], "left").withColumn("lemma", F.coalesce("lemma", token))
