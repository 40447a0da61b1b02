"""Problem 3: languages of queries and of the segments of mixed ones.

A linear-chain conditional random field labels the words of a query: word identity, affixes, character
n-grams, script and lexicon features, learned transitions between the languages, forward-backward for the
marginals. It is trained on the driver on a bounded sample of labelled rows: ``PER_LANGUAGE`` texts of
each language and ``LABELLED_QUERIES`` queries (after a first round on the texts alone has dropped those
whose label it contradicts), with code-switched sequences made by joining two of them. Features are
hashed to ``BUCKETS``, so the model that is broadcast has a fixed size. Every query is labelled.

A query typed in the wrong keyboard layout is read through the layouts; a reading is taken if the
lexicon knows its words and doesn't know the typed ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.tables import spread, table

LANGUAGES = ("ru", "en", "uk", "de", "fr", "es")
PER_LANGUAGE, LABELLED_QUERIES = 500, 6_000
BUCKETS = 1 << 17
#: Mean probability that the first round must give a query's label for the query to train the second.
TRUSTED = 0.6
MIN_SEGMENT_WORDS = 3
#: Words of each run where a query changes its language more than once, and what a change costs.
MIN_RUN_WORDS, SWITCH = 2, 1.2
#: Mean probability that each side of a mixed query must reach.
SEGMENT_CONFIDENCE = 0.8
#: The same where a separator stands between the sides.
SEPARATED_CONFIDENCE = 0.4
SEPARATOR = re.compile(r"[/,;:–—]| - ")

#: Names of the languages in labels.
LABELS = {
    "ru": "ru rus russian русский",
    "en": "en eng english английский",
    "uk": "uk ukr ukrainian ua украинский українська",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
}
_LABEL = {name: lang for lang, names in LABELS.items() for name in names.split()}

#: The keys of the two layouts in the same places.
_EN_KEYS = "qwertyuiop[]asdfghjkl;'zxcvbnm,.`QWERTYUIOP{}ASDFGHJKL:\"ZXCVBNM<>~"
_RU_KEYS = "йцукенгшщзхъфывапролджэячсмитьбюёЙЦУКЕНГШЩЗХЪФЫВАПРОЛДЖЭЯЧСМИТЬБЮЁ"
_UK_KEYS = "йцукенгшщзхїфівапролджєячсмитьбю'ЙЦУКЕНГШЩЗХЇФІВАПРОЛДЖЄЯЧСМИТЬБЮ'"
LAYOUTS = [str.maketrans(a, b) for a, b in ((_EN_KEYS, _RU_KEYS), (_EN_KEYS, _UK_KEYS), (_RU_KEYS, _EN_KEYS), (_UK_KEYS, _EN_KEYS))]

TOKEN = re.compile(r"[^\s,;!?()&|«»“”\"„]+")
ADDRESS = re.compile(r"https?:|www\.|@|\w/\w|\.(?:com|org|net|example|test|invalid|ru|de)\b|\d")
WORD = re.compile(r"[^\W\d_]+(?:['’`ʼ-][^\W\d_]+)*")
CYRILLIC = re.compile("[Ѐ-ӿ]")


def normal_label(label: str | None) -> str | None:
    """The language a label names in any spelling or regional form; None if it names none of the six."""
    if not label:
        return None
    low = label.strip().lower()
    return _LABEL.get(low) or _LABEL.get(re.split(r"[-_]", low)[0])


def words(query: str) -> list[tuple[str, int, int]]:
    """(word, first position, position after) of the words; numbers, codes and addresses are none."""
    out = []
    for m in TOKEN.finditer(query):
        if not ADDRESS.search(m.group()):
            out += [(w.group(), m.start() + w.start(), m.start() + w.end()) for w in WORD.finditer(m.group())]
    return out


def _hash(feature: str) -> int:
    return crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def word_features(word: str, lexicon: dict[str, tuple[int, ...]]) -> list[int]:
    """Hashed features of one word, all of its trigrams included."""
    low = word.lower().replace("’", "'")
    padded = f"^{low}$"
    out = [f"w={low}"] + [f"p{n}={low[:n]}" for n in (1, 2, 3) if len(low) >= n] + [f"s{n}={low[-n:]}" for n in (1, 2, 3, 4) if len(low) >= n]
    out.append("cyr" if CYRILLIC.search(low) else "name" if word[:1].isupper() else "lat")
    known = lexicon.get(low)
    if known:
        out += [f"lex={k}" for k, n in enumerate(known) if n == max(known)] + [f"only={k}" for k, n in enumerate(known) if n and sum(known) == n]
    else:
        out.append("unknown")
    if word[:1].isupper():
        out.append("cap")
    out += [f"g={padded[k : k + 3]}" for k in range(len(padded) - 2)]
    return [_hash(x) for x in out]


class Encoded:
    """Features of the words of some sequences, one after another: ``flat`` features, ``counts`` of each word, and each word's ``row`` and ``step``."""

    def __init__(self, sequences: list[list[str]], lexicon):
        cache: dict[str, np.ndarray] = {}
        found = []
        for sequence in sequences:
            for word in sequence:
                if word not in cache:
                    cache[word] = np.array(word_features(word, lexicon), dtype=np.int64)
                found.append(cache[word])
        self.length = np.array([len(s) for s in sequences], dtype=np.int64)
        self.counts = np.array([len(x) for x in found], dtype=np.int64)
        self.flat = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
        self.row = np.repeat(np.arange(len(sequences)), self.length)
        self.step = np.arange(len(found)) - np.repeat(np.cumsum(self.length) - self.length, self.length)

    def scores(self, emit: np.ndarray) -> np.ndarray:
        """Summed weights [sequence, word, language], 0 beyond a sequence's end."""
        out = np.zeros((len(self.length), max(1, int(self.length.max(initial=1))), emit.shape[1]))
        if len(self.flat):
            out[self.row, self.step] = np.add.reduceat(emit[self.flat], np.cumsum(self.counts) - self.counts, axis=0)
        return out


def encode(sequences: list[list[str]], lexicon) -> Encoded:
    return Encoded(sequences, lexicon)


#: A word's script rules languages out, except that capitalised Latin words may be names in any text; these weights aren't trained.
FIXED = {_hash("cyr"): (0, -8, 0, -8, -8, -8), _hash("lat"): (-8, 0, -8, 0, 0, 0)}


class Crf:
    def __init__(self):
        n = len(LANGUAGES)
        self.emit = np.zeros((BUCKETS, n), dtype=np.float32)
        self.move = np.eye(n, dtype=np.float64) * 2.0
        self.lexicon: dict[str, tuple[int, ...]] = {}
        self._fix()

    def _fix(self) -> None:
        for bucket, row in FIXED.items():
            self.emit[bucket] = row

    def marginals(self, x: Encoded) -> tuple[np.ndarray, np.ndarray]:
        """(word marginals [sequence, word, language], expected transitions summed over all words)."""
        score = x.scores(self.emit)
        size, steps, n = score.shape
        alive = np.arange(steps)[None, :] < x.length[:, None]
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, steps):
            step = _logsum(ahead[:, t - 1, :, None] + self.move[None], axis=1) + score[:, t]
            ahead[:, t] = np.where(alive[:, t, None], step, ahead[:, t - 1])
        for t in range(steps - 2, -1, -1):
            step = _logsum(self.move[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(alive[:, t + 1, None], step, 0.0)
        total = _logsum(ahead[:, -1], axis=1)
        out = np.exp(ahead + back - total[:, None, None]) * alive[..., None]
        moves = np.zeros((n, n))
        for t in range(1, steps):
            joint = ahead[:, t - 1, :, None] + self.move[None] + (score[:, t] + back[:, t])[:, None, :] - total[:, None, None]
            moves += (np.exp(joint) * alive[:, t, None, None]).sum(axis=0)
        return out, moves

    def fit(self, sequences: list[list[str]], labels: list[list[int]], epochs: int = 4, batch: int = 256, rate: float = 0.3, seed: int = 7) -> None:
        """Adaptive gradient ascent of the conditional likelihood."""
        order = np.random.default_rng(seed)
        seen_e = np.full(BUCKETS, 1e-3, dtype=np.float32)
        seen_m = np.full_like(self.move, 1.0)
        for _ in range(epochs):
            shuffled = order.permutation(len(sequences))
            for at in range(0, len(shuffled), batch):
                part = shuffled[at : at + batch]
                x = encode([sequences[k] for k in part], self.lexicon)
                steps = max(1, int(x.length.max(initial=1)))
                gold = np.zeros((len(part), steps, len(LANGUAGES)))
                moves = np.zeros_like(self.move)
                for row, k in enumerate(part):
                    y = labels[k]
                    gold[row, np.arange(len(y)), y] = 1
                    np.add.at(moves, (y[:-1], y[1:]), 1)
                expected, expected_moves = self.marginals(x)
                change = (gold - expected).astype(np.float32)
                per = np.repeat(change[x.row, x.step], x.counts, axis=0)
                used, where = np.unique(x.flat, return_inverse=True)
                grad = np.stack([np.bincount(where, per[:, c], minlength=len(used)) for c in range(len(LANGUAGES))], axis=1)
                seen_e[used] += (grad**2).max(axis=1)
                self.emit[used] += (rate * grad / np.sqrt(seen_e[used])[:, None]).astype(np.float32)
                self._fix()
                diff = moves - expected_moves
                seen_m += diff**2
                self.move += rate * diff / np.sqrt(seen_m)

    def label(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Word marginals of each sequence."""
        if not sequences:
            return []
        x = encode(sequences, self.lexicon)
        found, _ = self.marginals(x)
        return [found[k, :n] for k, n in enumerate(x.length)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


_PART = re.compile(r"[.!?…;\n]+")


def _fits(word: str, lang: int) -> bool:
    return bool(CYRILLIC.search(word)) == (LANGUAGES[lang] in ("ru", "uk"))


def train(texts: list[tuple[str, str]], queries: list[tuple[str, str]], seed: int = 11) -> Crf:
    """Train on (text, language) rows and on labelled queries."""
    rng = np.random.default_rng(seed)
    index = {lang: k for k, lang in enumerate(LANGUAGES)}
    sequences, labels = [], []
    for text, lang in texts:
        for part in _PART.split(text)[:40]:
            found = [w for w, _, _ in words(part)][:14]
            if len(found) > 2 and sum(_fits(w, index[lang]) for w in found) * 2 > len(found):
                sequences.append([w for w in found if _fits(w, index[lang])])
                labels.append(index[lang])
    model = Crf()
    model.lexicon = _lexicon(sequences, labels)
    _learn(model, sequences, labels, rng, 1)
    kept = [([w for w, _, _ in words(q)], index[lang]) for q, lang in queries]
    kept = [(s, y) for s, y in kept if s and all(_fits(w, y) or w[:1].isupper() for w in s)]
    kept = [([w for w in s if _fits(w, y)], y) for s, y in kept]
    guessed = model.label([s for s, _ in kept])
    trusted = [(s, y) for (s, y), p in zip(kept, guessed) if len(s) and p[:, y].mean() > TRUSTED]
    asked, asked_labels = [s for s, _ in trusted], [y for _, y in trusted]
    model.lexicon = _lexicon(sequences + asked, labels + asked_labels)
    _learn(model, sequences, labels, rng, 4, asked, asked_labels)
    return model


def _lexicon(sequences: list[list[str]], labels: list[int]) -> dict[str, tuple[int, ...]]:
    counts = [Counter() for _ in LANGUAGES]
    for sequence, y in zip(sequences, labels):
        counts[y].update(w.lower().replace("’", "'") for w in sequence if _fits(w, y))
    total = sum(counts, Counter())
    return {w: tuple(c[w] if c[w] * 20 > n else 0 for c in counts) for w, n in total.items() if n > 1}


def _learn(model: Crf, sequences, labels, rng: np.random.Generator, epochs: int, asked=(), asked_labels=()) -> None:
    """Fit on as many sequences of each language, half of them queries where there are any, and on joined ones."""
    n = len(LANGUAGES)
    from_texts = [[s for s, y in zip(sequences, labels) if y == k] for k in range(n)]
    from_queries = [[s for s, y in zip(asked, asked_labels) if y == k] for k in range(n)]
    present = [k for k in range(n) if from_texts[k] or from_queries[k]]

    def draw(k: int) -> list[str]:
        own = from_queries[k] if from_queries[k] and (not from_texts[k] or rng.random() < 0.5) else from_texts[k]
        return own[rng.integers(len(own))]

    xs, ys = [], []
    for k in present:
        for _ in range(1_500):
            s = draw(k)
            xs.append((s[int(rng.integers(0, 3)) :] or s)[:10])
            ys.append([k] * len(xs[-1]))
    for _ in range(4_000 if len(present) > 1 else 0):
        a, b = rng.choice(present, 2, replace=False)
        s, t = draw(a)[: int(rng.integers(3, 8))], draw(b)[: int(rng.integers(3, 8))]
        xs.append(s + t)
        ys.append([a] * len(s) + [b] * len(t))
    model.fit(xs, ys, epochs)


def coverage(model: Crf, found: list[tuple[str, int, int]]) -> float:
    """Share of the words that the lexicon knows."""
    return sum(w.lower() in model.lexicon for w, _, _ in found) / len(found) if found else 0.0


def readings(model: Crf, query: str) -> str:
    """The query as meant: itself, or its reading in another keyboard layout."""
    here = coverage(model, words(query))
    if here >= 0.5:
        return query
    best, chosen = max(0.5, here + 0.3), query
    for layout in LAYOUTS:
        other = query.translate(layout)
        if other != query:
            found = words(other)
            if found and (known := coverage(model, found)) >= best:
                best, chosen = known + 1e-6, other
    return chosen


def segments(found: list[tuple[str, int, int]], marginals: np.ndarray) -> list[tuple[str, int, int, float, int]]:
    """(language, first word, word after, confidence, words) of each run of words of one language.

    Capitalised Latin words in Cyrillic surroundings are names: they join the run they stand in.
    """
    tags = marginals.argmax(axis=1).tolist()
    cyrillic = [bool(CYRILLIC.search(w)) for w, _, _ in found]
    for k, (word, _, _) in enumerate(found):
        if not cyrillic[k] and word[:1].isupper() and (k and cyrillic[k - 1] or k + 1 < len(found) and cyrillic[k + 1]) and not (k + 1 < len(found) and not cyrillic[k + 1]):
            tags[k] = tags[k - 1] if k and cyrillic[k - 1] else tags[k + 1]
    out, start = [], 0
    for k in range(1, len(tags) + 1):
        if k == len(tags) or tags[k] != tags[start]:
            out.append((LANGUAGES[tags[start]], start, k, float(marginals[start:k, tags[start]].mean()), k - start))
            start = k
    return out


def best_runs(marginals: np.ndarray, switch: float) -> list[tuple[int, int, int]]:
    """(language, first word, word after) of the runs with the largest sum of marginals, less ``switch`` for each change of language."""
    n, size = marginals.shape
    best, back = marginals[0].copy(), []
    for t in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back.append(np.where(stay, np.arange(size), top))
        best = np.where(stay, best, best[top] - switch) + marginals[t]
    tags = [int(best.argmax())]
    for come in reversed(back):
        tags.append(int(come[tags[-1]]))
    tags.reverse()
    cuts = [0, *(k for k in range(1, n) if tags[k] != tags[k - 1]), n]
    return [(tags[a], a, b) for a, b in zip(cuts, cuts[1:])]


def _several(found, marginals: np.ndarray) -> list[tuple[str, int, int, float]]:
    """Three and more runs of words, such as a language within another one; empty unless all of them are sure."""
    runs = best_runs(marginals, SWITCH)
    out = [(LANGUAGES[k], a, b, float(marginals[a:b, k].mean())) for k, a, b in runs]
    sure = all(p >= SEGMENT_CONFIDENCE and b - a >= MIN_RUN_WORDS for _, a, b, p in out)
    return out if len(out) > 2 and sure else []


def answers(report: list[tuple[str, int, int, float]]) -> set[str]:
    """The languages that a query is reported to hold: those with enough words in all of its runs, else the one with the most."""
    words: dict[str, int] = {}
    for lang, a, b, _ in report:
        words[lang] = words.get(lang, 0) + b - a
    enough = {lang for lang, n in words.items() if n >= MIN_SEGMENT_WORDS}
    return enough if len(enough) > 1 else {max(words, key=words.__getitem__)}


def decide(found, marginals: np.ndarray, text: str = "") -> tuple[list[tuple[str, int, int, float]], bool]:
    """(segments to report as (language, first word, word after, confidence), whether the query is mixed)."""
    runs = segments(found, marginals)
    if len(runs) > 2:
        several = _several(found, marginals)
        if several:
            return several, len(answers(several)) > 1
    if len(runs) > 1:
        best = None
        total = np.concatenate([np.zeros((1, len(LANGUAGES))), np.cumsum(marginals, axis=0)])
        n = len(found)
        for cut in range(MIN_SEGMENT_WORDS, n - MIN_SEGMENT_WORDS + 1):  # one language and then another
            left, right = total[cut] / cut, (total[n] - total[cut]) / (n - cut)
            a, b = int(left.argmax()), int(right.argmax())
            if a != b:
                apart = bool(SEPARATOR.search(text[found[cut - 1][2] : found[cut][1]]))
                score = (left[a] * cut + right[b] * (n - cut)) / n + (0.2 if apart else 0.0)
                if best is None or score > best[0]:
                    best = (score, cut, a, b, left[a], right[b], apart)
        if best and min(best[4], best[5]) >= (SEPARATED_CONFIDENCE if best[6] else SEGMENT_CONFIDENCE):
            _, cut, a, b, p, q, _ = best
            return [(LANGUAGES[a], 0, cut, float(p)), (LANGUAGES[b], cut, n, float(q))], True
    script = [k for k in range(len(found)) if CYRILLIC.search(found[k][0])]
    rows = marginals
    if 0 < len(script) < len(found):  # names in Latin letters don't speak for the query
        common = [k for k in range(len(found)) if (k in script) == (len(script) * 2 >= len(found) - sum(w[:1].isupper() and not CYRILLIC.search(w) for w, _, _ in found))]
        rows = marginals[common] if common else marginals
    mean = rows.mean(axis=0)
    k = int(mean.argmax())
    return [(LANGUAGES[k], 0, len(found), float(mean[k]))], False


def _by_separator(model: Crf, found, text: str, report):
    """A separator with enough words on both sides: the sides are labelled on their own, without the transition between them."""
    for cut in range(MIN_SEGMENT_WORDS, len(found) - MIN_SEGMENT_WORDS + 1):
        if SEPARATOR.search(text[found[cut - 1][2] : found[cut][1]]):
            left, right = (m.mean(axis=0) for m in model.label([[w for w, _, _ in found[:cut]], [w for w, _, _ in found[cut:]]]))
            a, b = int(left.argmax()), int(right.argmax())
            if a != b and min(left[a], right[b]) >= SEPARATED_CONFIDENCE + 0.1:
                return [(LANGUAGES[a], 0, cut, float(left[a])), (LANGUAGES[b], cut, len(found), float(right[b]))], True
    return report, False


def fit(documents: DataFrame, queries: DataFrame) -> Crf:
    """Train on a bounded sample: the rows with the smallest hashes of their ids, so any run gets the same.

    Of a text, the first 2 000 characters, 40 sentences and 14 words of a sentence train the model; that bounds the fit only.
    """
    texts: list[tuple[str, str]] = []
    for lang in LANGUAGES:
        rows = documents.filter((F.col("lang") == lang) & F.col("text").isNotNull()).select(F.substring("text", 1, 2_000).alias("text"), "doc_id")
        texts += [(r.text, lang) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_LANGUAGE).collect()]
    rows = queries.filter("query is not null and lang is not null").orderBy(F.xxhash64("query_id"), "query_id").limit(LABELLED_QUERIES).select("query", "lang").collect()
    return train(texts, [(r.query, lang) for r in rows if (lang := normal_label(r.lang))])


def _rows(model: Crf, batch: pa.RecordBatch) -> list[tuple]:
    """(id, segment, start, end, language, confidence, mixed, answer, label language) of the batch's queries."""
    ids, texts, labels = (batch.column(k).to_pylist() for k in range(3))
    meant = [readings(model, q or "") for q in texts]
    found = [words(q) for q in meant]
    have = [k for k in range(len(ids)) if found[k]]
    out = []
    for at in range(0, len(have), 1024):
        part = have[at : at + 1024]
        for k, p in zip(part, model.label([[w for w, _, _ in found[k]] for k in part])):
            report, mixed = decide(found[k], p, meant[k])
            if not mixed:
                report, mixed = _by_separator(model, found[k], meant[k], report)
            open_answers = answers(report)
            for n, (lang, a, b, confidence) in enumerate(report):
                out.append((ids[k], n, found[k][a][1] + 1, found[k][b - 1][2], lang, round(confidence, 6), mixed, lang in open_answers, normal_label(labels[k])))
                open_answers.discard(lang)  # the first run of a language speaks for it
    return out


SCHEMA = "query_id bigint, segment int, start_pos bigint, end_pos bigint, lang string, confidence double, mixed boolean, answer boolean, label string"


def languages(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per query and segment: positions of the segment in the query as meant, language, confidence,
    whether the query is mixed, whether the row is the first of a language that the query holds with enough words
    (``answer``), and the language its label names.

    Queries without a word (null, empty, numbers, codes, addresses, marks) give no row; repeated rows give
    theirs each. ``documents`` (doc_id, text, lang) and the labelled queries train the model.
    """
    model = queries.sparkSession.sparkContext.broadcast(fit(documents, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.bool_(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            columns = list(zip(*_rows(model.value, batch))) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return queries.select("query_id", "query", "lang").mapInArrow(run, SCHEMA)


def _inputs(spark, sf_dir):
    return spread(table(spark, sf_dir, "queries").select("query_id", "query", "lang"), "query_id"), table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def p3_found(spark, sf_dir):
    """Queries whose label is missing or wrong with their language, and both languages of mixed ones."""
    found = languages(*_inputs(spark, sf_dir))
    return found.filter("answer and (mixed or label is null or label <> lang)").select("query_id", "lang")


def p3_segments(spark, sf_dir):
    return languages(*_inputs(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_segments": p3_segments}
SQL: dict[str, str] = {}
