"""Problem 5: per-document text quality statistics and the rule that tells prose from junk.

A text is cut into chunks of ``CHUNK`` characters. Each chunk yields partial counts: what needs only
some characters of context (words, sentence ends, separators, symbols) is counted where it begins or ends,
with ``MARGIN`` characters around the chunk, so it simply adds up; what needs a whole line (items, tables,
share of lines with an end mark) is counted for the lines inside the chunk, while the pieces of the lines
that cross its ends stay open as head and tail state. How an open line ends is kept as the transition map
of a small automaton, so that pieces compose exactly wherever the text is cut. ``merge`` is associative and
joins the tail of one state with the head of the next. States are merged in a tree: by groups of chunks,
then by document, each level a hash aggregation whose input is one small row per chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.tables import spread, table

CHUNK, MARGIN, FAN = 32_768, 48, 256

#: Frequent function words of the collection's languages.
COMMON_WORDS = frozenset(
    "the a an and or but of in on at to for with from by is are was were that this it as not be has have every while "
    "и в во на не что с со а но как по из у за от до для о об же так или его ее бы это "
    "і й та в у на не що з із зі а але як по за від до для про його це або без "
    "der die das den dem des ein eine und oder aber von zu mit auf für ist sind nicht auch es er sie im am unter nach "
    "le la les un une des et ou mais de du dans en au aux pour avec par est sont ne pas que qui sur sous "
    "el los las unos unas y o pero del al por para con es son no se lo su sin sobre".split()
)

WORD = re.compile(r"\w+")
#: A sentence end: a mark after a word that is too long for an abbreviation, a number, a bracket or a non-ASCII sign, before a capital (in swapped case too), a quotation mark or the end of the line.
SENTENCE_END = re.compile(r"(?:[^\W\d_]{4}|\d|[»”’\"')\]]|[^\x00-\x7f\w])[.!?…]{1,12}[»”’\"')\]]{0,4}(?=[ \t]{0,20}(?:[\r\n]|\Z)|[ \t]{1,20}(?:[«“„\"'(¿¡—A-ZÀ-ÞЀ-Я]|[а-яё][А-ЯЁ]{2}|[^\x00-\x7f\w]))")
FULL_STOP = re.compile(r"[^\W\d_]{2}[.!?…]+[»”’\"')\]]*\s*\Z")
END_MARK = re.compile(r"[.!?…:;][»”’\"')\]]*\s*\Z")
ASCII_SYMBOL = re.compile(r"[!#$%&*+/<=>?@\[\\\]^_`{|}~]")
#: Signs that correct text in the collection's scripts hardly uses; many of them mean a wrong encoding.
ODD = re.compile(r"[^\x00-\x7f\w\s«»“”„’‘—–…·•№°©€¡¿]")
#: Between the cells of a row: signs, a comma without a blank, and a character after two blanks.
SEPARATOR = re.compile(r"[|;\t#]|,(?=\S)|(?<=  )[^\s|;\t#]")
INDENTED = re.compile(r"\A {2,}\S")

ADDITIVE = ("n_chars", "n_blank", "n_letters", "n_digits", "n_symbols", "n_words", "word_chars", "n_common", "n_sentences", "n_long_words", "n_odd")
#: Counts over finished lines.
LINE = ("n_lines", "lines_ended", "item_lines", "junk_words")
#: State of an unfinished line: words, visible characters, separators, digits, clause marks, whether its first visible character
#: follows two blanks, and the transition maps of the automata that say how it ends.
OPEN = ("words", "chars", "seps", "digits", "marks", "lead", "stop_map", "end_map")

STATE = [(n, "bigint") for n in ADDITIVE + LINE] + [("broken", "boolean")] + [(f"{side}_{n}", "bigint") for side in ("head", "tail") for n in OPEN]
_NAMES = [n for n, _ in STATE]


_CLOSERS = frozenset("»”’\"')]")
#: Kinds of characters for the automata, and the next state for each state and kind. States of ``_STOP``: other, one letter, two or
#: more, a mark after two letters, closing signs after it, blanks after these; of ``_END``: other, mark, closing signs, blanks.
_STOP = {"letter": (1, 2, 2, 1, 1, 1), "full": (0, 0, 3, 3, 0, 0), "colon": (0,) * 6, "closer": (0, 0, 0, 4, 4, 0), "blank": (0, 0, 0, 5, 5, 5), "other": (0,) * 6}
_END = {"letter": (0,) * 4, "full": (1,) * 4, "colon": (1,) * 4, "closer": (0, 2, 2, 0), "blank": (0, 3, 3, 3), "other": (0,) * 4}
_STOPPED, _ENDED = (3, 4, 5), (1, 2, 3)


def _kind(c: str) -> str:
    if c.isalpha():
        return "letter"
    if c.isspace():
        return "blank"
    return "full" if c in ".!?…" else "colon" if c in ":;" else "closer" if c in _CLOSERS else "other"


def _transitions(piece: str) -> tuple[int, int]:
    """The maps of a piece of a line, each written as one number (the state reached from state k is its digit k)."""
    at, letters = len(piece), 0
    while at and letters < 2:  # from two letters or any other sign on, the states before don't matter
        at -= 1
        kind = _kind(piece[at])
        letters = letters + 1 if kind == "letter" else 0
        if kind == "other":
            break
    stop, end = list(range(6)), list(range(4))
    for c in piece[at:]:
        kind = _kind(c)
        stop, end = [_STOP[kind][k] for k in stop], [_END[kind][k] for k in end]
    return sum(v * 6**k for k, v in enumerate(stop)), sum(v * 4**k for k, v in enumerate(end))


def _compose(a: int, b: int, n: int) -> int:
    """The map of a piece followed by another."""
    return sum(b // n ** (a // n**k % n) % n * n**k for k in range(n))


def _piece(text: str, before: str, after: str, marks: int) -> tuple[int, ...]:
    """State of a piece of a line between the characters before and after it in the same line."""
    whole, at = before + text + after, len(before)
    end = at + len(text)
    words = sum(at <= m.start() < end for m in WORD.finditer(whole))
    seps = sum(at <= m.start() < end for m in SEPARATOR.finditer(whole))
    first = len(text) - len(text.lstrip())
    lead = first < len(text) and whole[max(0, at + first - 2) : at + first] == "  " and not SIGN.match(text[first])
    return (words, len(text) - sum(map(str.isspace, text)), seps, sum(map(str.isdigit, text)), marks, int(lead), *_transitions(text))


#: Separators that count whether they are indented or not.
SIGN = re.compile(r"[|;#]")


def _line(text: str, marks: int) -> tuple[int, ...]:
    """(lines, lines with an end mark, item lines, junk words) of a whole line."""
    body = text.strip()
    if not body:
        return 0, 0, 0, 0
    seps = len(SEPARATOR.findall(text)) - bool(INDENTED.match(text) and not SIGN.match(body))
    return _counted(len(WORD.findall(body)), len(body) - sum(map(str.isspace, body)), seps, sum(map(str.isdigit, body)), marks, bool(FULL_STOP.search(text)), bool(END_MARK.search(text)))


def _counted(words: int, chars: int, seps: int, digits: int, marks: int, stopped: bool, ended: bool) -> tuple[int, ...]:
    blob = words >= 25 and marks * 40 < words
    listed = not marks and (seps >= 2 or digits >= 8) or digits * 2 > chars + words - 1
    item = not marks and words <= 7 and not (stopped and words >= 3)
    return 1, int(ended), int(item), words if blob or listed or item else 0


def _closed(line: tuple[int, ...]) -> tuple[int, ...]:
    """Counts of an open line that is finished; it begins in state 0."""
    words, chars, seps, digits, marks, lead, stop_map, end_map = line
    return _counted(words, chars, seps - lead, digits, marks, stop_map % 6 in _STOPPED, end_map % 4 in _ENDED) if chars else (0, 0, 0, 0)


def count_chunk(chunk: str, before: str = "", after: str = "") -> dict[str, int | bool]:
    """Partial counts of ``chunk`` between the characters ``before`` and ``after`` it."""
    whole, at, end = before + chunk + after, len(before), len(before) + len(chunk)
    words = [m for m in WORD.finditer(whole) if at <= m.start() < end]  # a word counts where it begins
    marks = [m.end() - at for m in SENTENCE_END.finditer(whole) if at < m.end() <= end]
    lengths = [len(m.group()) for m in words]  # up to the margin, which is beyond any limit asked for
    out = {
        "n_chars": len(chunk),
        "n_blank": sum(map(str.isspace, chunk)),
        "n_letters": sum(map(str.isalpha, chunk)),
        "n_digits": sum(map(str.isdigit, chunk)),
        "n_symbols": len(ASCII_SYMBOL.findall(chunk)),
        "n_words": len(words),
        "word_chars": sum(max(0, min(m.end(), end) - max(m.start(), at)) for m in WORD.finditer(whole)),
        "n_common": sum(m.group().lower() in COMMON_WORDS for m in words),
        "n_sentences": len(marks),
        "n_odd": len(ODD.findall(chunk)),
        "n_long_words": sum(n > 25 for n in lengths),
    }
    lines = chunk.split("\n")
    ended = [0] * len(lines)  # sentence ends in each line
    line, line_end = 0, len(lines[0])
    for m in marks:
        while m > line_end:
            line += 1
            line_end += 1 + len(lines[line])
        ended[line] += 1
    out["broken"] = len(lines) > 1
    inner = [_line(x, n) for x, n in zip(lines[1:-1], ended[1:-1])]
    out.update(zip(LINE, (sum(x) for x in zip(*inner)) if inner else (0,) * len(LINE)))
    same_before, same_after = before.rpartition("\n")[2], after.partition("\n")[0]
    out.update(zip((f"head_{n}" for n in OPEN), _piece(lines[0], same_before, "" if len(lines) > 1 else same_after, ended[0])))
    out.update(zip((f"tail_{n}" for n in OPEN), _piece(lines[-1], "", same_after, ended[-1]) if len(lines) > 1 else _EMPTY))
    return out


_EMPTY = _piece("", "", "", 0)


def _glue(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    """Two pieces of one line."""
    return (*(x + y for x, y in zip(a[:5], b[:5])), a[5] if a[1] else b[5], _compose(a[6], b[6], 6), _compose(a[7], b[7], 4))


def merge(a: dict, b: dict) -> dict:
    """State of the text of ``a`` followed by that of ``b``; associative."""
    out = {n: a[n] + b[n] for n in ADDITIVE + LINE}
    part = lambda s, side: tuple(s[f"{side}_{n}"] for n in OPEN)
    head, tail = part(a, "head"), part(b, "tail")
    if a["broken"] and b["broken"]:
        for n, v in zip(LINE, _closed(_glue(part(a, "tail"), part(b, "head")))):
            out[n] += v
    elif a["broken"]:
        tail = _glue(part(a, "tail"), part(b, "head"))
    else:
        head = _glue(part(a, "head"), part(b, "head"))
    out["broken"] = a["broken"] or b["broken"]
    out.update(zip((f"head_{n}" for n in OPEN), head))
    out.update(zip((f"tail_{n}" for n in OPEN), tail))
    return out


def finish(state: dict) -> dict:
    """Counts of a whole text: the open first and last line are lines too."""
    out = {n: state[n] for n in ADDITIVE + LINE}
    for side in ("head", "tail") if state["broken"] else ("head",):
        for n, v in zip(LINE, _closed(tuple(state[f"{side}_{n}"] for n in OPEN))):
            out[n] += v
    return out


def _fold(states: list[dict]) -> dict:
    out = states[0]
    for state in states[1:]:
        out = merge(out, state)
    return out


def partial_states(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per chunk of each text that isn't null: the key, ``part`` and the state's columns."""
    kind = dict(df.dtypes)[key]
    side = lambda at, cut: F.coalesce(F.expr(f"{cut}(get(chunks, {at}), {MARGIN})"), F.lit(""))
    chunks = (
        df.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .filter("text is not null")
        # one pass over the text, however many chunks it has
        .select("key", F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("chunks"))
        .select("key", "chunks", F.posexplode("chunks").alias("part", "chunk"))
        .select("key", "part", "chunk", side("part - 1", "right").alias("before"), side("part + 1", "left").alias("after"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = [count_chunk(*x) for x in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            columns = [pa.array([s[n] for s in states], pa.bool_() if t == "boolean" else pa.int64()) for n, t in STATE]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["key", "part", *_NAMES])

    return chunks.mapInArrow(run, f"key {kind}, part int, " + ", ".join(f"{n} {t}" for n, t in STATE))


def _merge_udf(final: bool):
    names = list(ADDITIVE + LINE) if final else _NAMES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for states in batch.column("states").to_pylist():
                states.sort(key=lambda s: s["part"])
                state = _fold(states)
                out.append(finish(state) if final else state)
            columns = [pa.array([s[n] for s in out], pa.bool_() if n == "broken" else pa.int64()) for n in names]
            keep = [batch.column("key")] + ([] if final else [batch.column("part")])
            yield pa.RecordBatch.from_arrays([*keep, *columns], names=["key"] + ([] if final else ["part"]) + names)

    return run


def counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Final counts per document by a tree of merges: chunks, groups of ``FAN`` chunks, document."""
    states = partial_states(df, key, text)
    kind = dict(states.dtypes)["key"]
    struct = F.struct("part", *_NAMES)
    tree = (
        states.groupBy("key", F.floor(F.col("part") / FAN).cast("int").alias("group"))
        .agg(F.collect_list(struct).alias("states"))
        .withColumnRenamed("group", "part")
        .select("key", "part", "states")
        .mapInArrow(_merge_udf(False), f"key {kind}, part int, " + ", ".join(f"{n} {t}" for n, t in STATE))
    )
    return (
        tree.groupBy("key")
        .agg(F.collect_list(struct).alias("states"))
        .mapInArrow(_merge_udf(True), f"key {kind}, " + ", ".join(f"{n} bigint" for n in ADDITIVE + LINE))
    )


def statistics(df: DataFrame, key: str = "rec_id", text: str = "text") -> DataFrame:
    """Counts, ratios and the outcome ``is_junk`` per row of ``df`` whose text isn't null; ``key`` is unique.

    A blank or empty text has zero counts, null ratios and ``is_junk`` false. Texts of any length
    are counted whole. Other columns are ignored. An empty table gives no row.
    """
    ratio = lambda a, b: F.round(F.col(a) / F.when(F.col(b) > 0, F.col(b)), 6)
    visible = F.col("n_chars") - F.col("n_blank")
    symbols = F.col("n_symbols") / F.when(visible > 0, visible)
    mean_word = F.col("word_chars") / F.when(F.col("n_words") > 0, F.col("n_words"))
    junk = (visible > 0) & (
        F.coalesce(symbols > SYMBOL_SHARE, F.lit(False))
        | (F.coalesce(mean_word, F.lit(99.0)) > MEAN_WORD)
        | ((F.col("n_sentences") <= FEW_SENTENCES) & (F.col("junk_words") >= JUNK_WORDS))
        | ((F.col("n_sentences") <= QUOTED_SENTENCES) & (F.col("junk_words") >= JUNK_SHARE * F.col("n_words")) & (F.col("junk_words") >= 2 * JUNK_WORDS) & (F.col("n_odd") < GARBLED_SHARE * visible))
    )
    return (
        counts(df, key, text)
        .withColumn("mean_word_length", ratio("word_chars", "n_words"))
        .withColumn("symbol_ratio", F.round(symbols, 6))
        .withColumn("line_end_share", ratio("lines_ended", "n_lines"))
        .withColumn("common_word_share", ratio("n_common", "n_words"))
        .withColumn("digit_share", F.round(F.col("n_digits") / F.when(visible > 0, visible), 6))
        .withColumn("is_junk", junk)
        .withColumnRenamed("key", key)
    )


#: Thresholds of the rule: ASCII symbols among visible characters, mean word length, sentences that a junk page may hold, words in lists, tables and blobs;
#: abbreviations and quoted speech make two sentences look like up to six, then most words must be junk and the text not garbled.
SYMBOL_SHARE, MEAN_WORD, FEW_SENTENCES, JUNK_WORDS = 0.2, 16.0, 2, 9
QUOTED_SENTENCES, JUNK_SHARE, GARBLED_SHARE = 6, 0.6, 0.03


def p5_found(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "crawl_document").select("rec_id", "text"), "rec_id")
    return statistics(pages).filter("is_junk").select("rec_id")


def p5_statistics(spark, sf_dir):
    return statistics(spread(table(spark, sf_dir, "crawl_document").select("rec_id", "text"), "rec_id"))


def p5_counts(spark, sf_dir):
    """Characters, words and the mean length of the words of each text."""
    return p5_statistics(spark, sf_dir).select("rec_id", "n_chars", "n_words", "word_chars", "mean_word_length")


QUERIES = {"p5_found": p5_found, "p5_statistics": p5_statistics, "p5_counts": p5_counts}
SQL = {
    "p5_counts": r"""
        select rec_id, length(text) n_chars, len(w) n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) word_chars,
            case when len(w) > 0 then round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) end mean_word_length
        from (select rec_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') w from crawl_document where text is not null)""",
}
