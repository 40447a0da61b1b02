"""Problem 10: sentence boundaries across languages and scripts.

Blank lines and list items cut a text into blocks. In a block every end mark (in Thai, which has none,
every blank) is a candidate character, tagged boundary (B) or inside (I) by a linear-chain model: each
candidate has observation features (character classes and affixes around the mark, lexicons of
abbreviations and words of saying), neighbouring tags have transition features with the distance between
the candidates, and Viterbi decoding finds the best sequence. The weights come from an averaged structured
perceptron. Its labelled sample is bounded: the sentences of ``TRAINING`` (marked by hand, all languages
of the collection), put together anew to ``SEQUENCES`` sequences; for scripts without marks the texts are
stripped of punctuation before training. Characters inside quotation marks are no candidates. The time is
linear in the length of the text.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.tables import spread, table

BLOCK = re.compile(r"(?:\r?\n[^\S\n]*)(?:\r?\n[^\S\n]*)+|\r?\n(?=[ \t]*[-•] )")
ITEM = re.compile(r"\s*[-•] ")
LINE_END = re.compile(r"\r?\n")
MARKS = re.compile(r"[.!?…。！？।॥؟۔]+")
CLOSERS = "»”’\"'“」』）)]›"
PAIRS = {"«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "‹": "›"}
QUOTES = re.compile("[«»“”„「」『』‹›\"]")
THAI = re.compile(r"[฀-๿]")
THAI_BLANK = re.compile(r"(?<=\S)[^\S\r\n]+(?=\S)")
#: What a word before a mark can't contain; words longer than ``LONG_WORD`` are no abbreviations.
BREAK = re.compile(r"[\s«»“”„\"(]")
LONG_WORD = 40
NEXT = re.compile(r"\S")
NEXT_WORD = re.compile(r"\s*(\w+)")
#: One word, and nothing after it.
LONE = re.compile(r"\s*\S*\s*\Z")

#: Abbreviations that stand before a name, a number or the rest of the sentence.
LEADING = frozenset(
    "mr mrs ms dr prof st no vs cf ch p pp fig vol ed jan feb mar apr jun jul aug sep sept oct nov dec approx gen sen rep gov capt lt col mt "
    "г гг им ул стр рис см ок тыс руб шт проф акад тов гр обл р д кв янв февр мар апр авг сент окт нояб дек напр т.е т.н i.e e.g "
    "ім вул буд див тис грн с рр обл напр тобто "
    "nr vgl bzw ca z d h s hr fr dipl ing str abs art "
    "m mme mlle ex av sr sra srta dra ud uds pág núm ej vol cap fig fol "
    "डॉ श्री د أ".split()
)
#: Abbreviations that may end a sentence.
ENDING = frozenset("etc inc ltd co corp jr p.m a.m usw u.a др т.д т.п д п пр др.".split())
#: Those of them that stand before a number only.
NUMBERED = frozenset("no ch p pp fig vol nr стр рис с буд кв pág núm art abs fol cap".split())
#: Month names that follow an ordinal number.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
#: How words of saying begin where the script has no small letters.
SAYING = ("他说", "她说", "他写道", "她写道", "他问", "她问", "と", "って", "उसने", "कहा", "قال", "he said", "she said")


def _kind(c: str) -> str:
    if c.isdigit():
        return "digit"
    if c.isupper():
        return "upper"
    if c.islower():
        return "lower"
    if c in "«“„\"'‘「『¿¡(":
        return "open"
    if c in "—–-,;:.!?…»”)」、，；：%/":
        return "join"
    return "letter" if c.isalpha() else "sign"


def _next_kind(text: str, at: int) -> str:
    """Kind of the first visible character from ``at``."""
    found = NEXT.search(text, at)
    return _kind(found.group()) if found else "end"


class Candidate:
    """A character that may end a sentence: where the sentence would end, the mark, whether a single word stands between it and the candidate before."""

    __slots__ = ("end", "at", "features", "shape", "lone")

    def __init__(self, end: int, at: int, features: list[str], shape: str, lone: bool):
        self.end, self.at, self.features, self.shape, self.lone = end, at, features, shape, lone


def candidates(text: str) -> list[Candidate]:
    """The candidates of a block in order."""
    thai = len(THAI.findall(text)) * 2 > len(text)
    if thai:
        found = list(THAI_BLANK.finditer(text))
        cuts = [0, *(m.end() for m in found), len(text)]
        return [Candidate(m.start(), m.start(), _thai_features(text, m.start(), m.end(), m.start() - cuts[k], cuts[k + 2] - m.end()), "blank", False) for k, m in enumerate(found)]
    spans = _quoted(text)
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    within = lambda at: (k := bisect_left(starts, at)) > 0 and at <= ends[k - 1]
    breaks = [m.start() for m in BREAK.finditer(text)]
    out, before = [], 0
    for m in MARKS.finditer(text):
        at, end = m.start(), m.end()
        quoted = spans and within(at)
        while end < len(text) and text[end] in CLOSERS and (_closes(ends, end) or text[end] != "“" and (quoted or text[end] not in "\"'")):
            end += 1
        if end == len(text) or spans and within(end):
            continue
        shape = _shape(m.group())
        k = bisect_left(breaks, at)
        start = breaks[k - 1] + 1 if k else 0
        word = text[start:at] if at - start <= LONG_WORD else ""
        out.append(Candidate(end, at, _features(text, m.group(), shape, word, at, end), shape, bool(LONE.match(text[before : min(at, before + 200)])) and at - before < 200))
        before = end
    return out


def _shape(mark: str) -> str:
    if len(mark) > 1 and set(mark) <= set(".…") or "…" in mark:
        return "dots"
    return "stop" if mark[0] == "." else "full" if mark[0] in "。！？।॥؟۔" else "ask"


def _thai_features(text: str, at: int, after: int, length: int, following: int) -> list[str]:
    """Classes of the characters beside a blank, and the lengths of the stretches it parts."""
    left, right = text[at - 1], text[after]
    size = lambda n: "short" if n < 6 else "long"
    kind = lambda c: "thai" if "\u0e00" <= c <= "\u0e7f" else _kind(c)
    return ["blank", f"left={kind(left)}", f"right={kind(right)}", f"pair={kind(left)}{kind(right)}", f"sizes={size(length)}{size(following)}", f"comma={left in ',;:'}", f"again={left == 'ๆ'}"]


def _quoted(text: str) -> list[tuple[int, int]]:
    """Spans (first, last position) of balanced quotations; a quotation that isn't closed in its block is none."""
    spans, stack = [], []
    for m in QUOTES.finditer(text):
        c, at = m.group(), m.start()
        if stack and (c in stack[-1][1]):
            start = stack.pop()[0]
            if not stack:
                spans.append((start, at))
        elif c in PAIRS:
            stack.append((at, PAIRS[c]))
        elif c == '"':
            stack.append((at, '"'))
    return spans


def _closes(ends: list[int], at: int) -> bool:
    k = bisect_left(ends, at)
    return k < len(ends) and ends[k] == at


def _features(text: str, mark: str, shape: str, word: str, at: int, end: int) -> list[str]:
    kind = _next_kind(text, end)
    glued = not text[end].isspace()
    closed = end > at + len(mark)
    out = [f"{shape}>{kind}{'+' if glued else ''}", f"{shape}<{_kind(text[at - 1]) if at else 'none'}", f"{'closed' if closed else 'open'}{shape}"]
    if closed:
        out.append(f"closed>{kind}")
    following = NEXT.search(text, end)
    if closed and following and text.startswith(SAYING, following.start()) or shape in ("dots", "full") and text.startswith(("と", "って"), end):
        out.append("saying")
    if shape == "stop" and not closed:
        out += _word_features(text, word, kind, glued, at, end)
    return out


def _word_features(text: str, word: str, kind: str, glued: bool, at: int, end: int) -> list[str]:
    """What the word before a full stop tells: its length and affixes, and the lexicons that know it."""
    if len(word) == 1 and word.isupper():
        return ["initial"]
    low = word.lower()
    out = [f"len={min(len(low), 5)}>{kind}", f"end={low[-2:]}", "vowel" if VOWEL.search(low) else "no vowel"]
    if low in ENDING and (len(low) > 1 or text[max(0, at - 4) : at - 1].lstrip().startswith(("т.", "т. "))):
        return out + ["ending"]
    if low in LEADING and (kind == "digit" or low not in NUMBERED):
        return out + ["leading"]
    if len(low) == 1 and low.isalpha():
        return out + ["initial"]
    if low.isdigit():
        follow = NEXT_WORD.match(text, end)
        return out + ["ordinal" if follow and follow.group(1).lower() in MONTHS else "number"]
    if glued:
        return out + ["glued-word" if kind == "upper" and low[-1:].isalpha() and len(low) > 3 and "." not in low and "/" not in low else "glued-part"]
    return out + ["dotted" if "." in low and len(low) < 6 else "word"]


VOWEL = re.compile("[aeiouyäöüáéíóúèêàâôîûœаеёиоуыэюяіїє]")


#: Texts with their boundaries (|). Those of scripts without marks are stripped of punctuation first.
TRAINING = (
    "The page is old.|A new page came.|Is it true?!|Yes, it is!|She left.",
    "Mr. Smith and H. L. Brown met at No. 20, Mill St., before noon.|They left.|Dr. Wood said no.|Prof. King asked why.",
    "Approx. 69.12 km vs. 21.89 km (cf. ch. 14) is far.|The value rose by 5.3 percent, i.e. John gained.|See p. 4, fig. 18.|Good.",
    "It was signed by Wood Ltd., Hill Inc. and others, etc.|The doors close at 3 p.m.|The doors open at 2 a.m. and close late.|End.",
    "The team waited... but nobody came.|Well... every clock stopped.|Well... Anna went home.|He sold the cheese...|It's late.|So it goes.",
    "\"Is it cold?\" asked Prof. Wood.|“We go!” said Anna.|“It is cold. We stay.”|Then they left.|Version 6.8.3 came out on 15 Jan. 2002 and works.|Fine.",
    "See www.site.example/page.html for details.|The page closes the museum.|The school feeds everyone.|It's John's turn, and I'd wait.|Go.",
    "Он составил ок. 2,98 тыс. км, т.е. Иван ждёт.|Продаются лампы, книги, карты и т. д.|Без него нельзя.|Проф. С. Г. Недов отметил, что пора.|Завод им. К. Попова стоит на ул. Мельничной, д. 4, в г. Дорожном.|Да.",
    "В 2020 г. Иван ждёт концерт, т. е. До конца дня.|Версия 6.1 вышла 31 янв. 2005 г., и всё.|Цена выросла до 18 руб. за шт., см. рис. 26.|Адрес указан на стр. 31.|Река ждёт.|Неужели?!|Нет.",
    "«Порт открыт!» — сказал Иван.|Иван писал: «Порт открыт. Мост закрыт».|Потом ушёл.|Команда ждала... но напрасно.|Вода ушла...|Стало тихо.|«Где он? Здесь!»|Никто не знал.",
    "Тут є лампи, книги, карти і т. д.|У 1966 р. Іван чекав.|Ціна зросла до 8 тис. грн, див. рис. 6.|Завод ім. Н. Сорта стоїть на вул. Садовій, буд. 15.|Команда чекала... але дарма.|Кінець.",
    "Es gibt Brot usw.|Am 21. Januar kam Nr. 24 heraus, vgl. S. 16.|Dr. Braun sagt, z. B. am 12. Mai 1996.|Die Strecke misst ca. 18,78 km, d. h. Anna wartet.|„Das ist alt!“, rief Anna.|Man wartete... aber nichts kam.|Ende.",
    "On vend des cartes, etc.|Voir p. 15, fig. 3.|La distance est de 6 km, p. ex. Anna part.|« Le pont est grand ! » dit Anna.|M. Blanc attendait... mais rien.|Fin.",
    "El Sr. Blanco y la Dra. D. Castro dicen que no.|La distancia es de 7 km, p. ej. Ana sale.|«¡Vamos!», dijo Ana.|Véase pág. 10, núm. 21.|La mesa es vieja.|¿Es verdad?|¡Sí!|Panes, mapas, etc.|Fin.",
    "画家画画。|真的吗？！|“修理了！”他说。|他说：“来了。走了？”|读者走了。|「来了。」她写道，走了。|长度是75.95公里。|完了！|好。",
    "先生は描いた……と聞いた。|本当に？！|「来た。行った。」と先生は言った。|長さは66.6キロで終わり。|船長は読んだ！|はい。",
    "किसान आता है।|\"वह आया। वह गया।\" उसने कहा।|डॉ. पाठक पढ़ता है।|क्या यह सच है?|हाँ।|संस्करण 1.0.6 आ गया।|ठीक।",
    "يكتب الرجل.|قال د. المعلم: «جاء. ذهب».|هل هذا صحيح؟|نعم.|صدر الإصدار 6.1.3 ثم ذهب.|انتهى.",
    "Well... Bob left.|Well... Mary sings.|Well... Tom ran.|Well... Eve came.|The rain...|Well... Sam sat.|He went...|Ann ran.",
    "The cat sat.The dog ran.|It was over!The end came.",
    "Well... the old clock stopped near the station at noon...|Nobody in the town saw it.|Well... a late train passed the quiet village again...|The guard slept.|Well... the whole street was dark...|Mr. Hill came home.|Fine.",
    "Dr. Stein sagt, z. B. am 17. Mai 1992.|Das Treffen am 3. August 2001 war kurz.|Frau Dr. Weber kam am 28. Februar 1987 an.|Es begann am 9. Juni 1975.|Prof. Wolf schrieb am 30. Oktober 1969, es sei gut.|Gut.",
    "Le jardin reste fermé.|Voir www.site.example/page.html, p. 11, fig. 7.|La maison est ouverte.|Mme Noir part.|Fin.",
    "Магазин помнит улицу.|Версия 7.1.2 вышла 11 янв. 1979 г., и всё.|Он ждал до вечера... но зря.|Наступил вечер...|Иван ушёл.|Да.",
)
#: Thai texts; ``~`` is a blank inside a sentence.
THAI_TRAINING = (
    "ครูซื้อแผนที่|ผู้อ่านพบกล้อง|ชาวนาอ่านจดหมาย",
    "เจ้าของร้านซื้อขนมปัง|วิศวกรซ่อมกล้อง|เขามา|เธอไป",
    "วันนี้อากาศดี|เด็ก 12 คนเล่นที่สวน".replace(" ", "") + "|ร้านปิดเวลา 18.30 น".replace(" ", ""),
    "เขาซื้อขนมปัง,~นม,~และไข่|เธอกลับบ้าน",
    "มีหลายอย่าง:~ปลา;~ข้าว|ทุกคนชอบ",
    "รถไฟมาถึง 2 ขบวน".replace(" ", "") + "|GPS ใช้งานได้".replace(" ", "") + "|ค่อยๆ|เดินไป",
)
#: Sequences put together from the training sentences, with a fixed seed.
SEQUENCES, SEED = 400, 5


def _joined(parts: list[str], kind: str) -> tuple[str, set[int]]:
    """A text made of sentences, and where they end."""
    text, cuts = "", set()
    for part in parts:
        if text:
            cuts.add(len(text))
            text += "" if kind == "dense" or kind == "glued" and GLUED.search(text) and part[:1].isupper() else " "
        text += part
    return text, cuts


#: Sentences that the next may follow without a blank: they end in a word of some length.
GLUED = re.compile(r"[^\W\d_]{4}[.!?]\Z")


def _examples() -> list[tuple[str, set[int]]]:
    out, pool = [], []
    for sample in TRAINING:
        parts = sample.split("|")
        kind = "dense" if re.search(r"[。！？]|[぀-ヿ一-鿿]", sample) else "spaced"
        text, cuts = _joined(parts, kind)
        out.append((text, cuts | {m.end() for m in re.finditer(r"(?<=sat)\.(?=The)|(?<=over)!(?=The)", text)}))
        if "sat.The" not in sample:
            pool.append((parts[:-1], kind))
    for sample in THAI_TRAINING:
        parts = [re.sub(r"[^\w฀-๿~,;:]", "", part) for part in sample.split("|")]
        text, cuts = _joined(parts, "thai")
        out.append((text.replace("~", " "), cuts))
    rng = random.Random(SEED)
    for _ in range(SEQUENCES):
        parts, kind = rng.choice(pool)
        kind = "glued" if kind == "spaced" and rng.random() < 0.2 else kind
        out.append(_joined([rng.choice(parts) for _ in range(rng.randint(2, 6))] + [parts[-1]], kind))
    return out


def _move(before: bool, tag: bool, shape: str, lone: bool) -> tuple[str, str]:
    """Transition features of two neighbouring tags; the text begins after a boundary."""
    name = f"{'B' if before else 'I'}{'B' if tag else 'I'}"
    return name, f"{name}|{shape}|{'lone' if lone else 'apart'}"


class BoundaryModel:
    """Linear-chain model over the candidates of a block: weights of the features with tag B (against I), and of the transitions."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def decode(self, found: list[Candidate]) -> list[bool]:
        """Viterbi: the best sequence of tags."""
        weigh = self.weights.get
        best = {True: 0.0}
        back: list[dict[bool, bool]] = []
        for c in found:
            seen = sum(weigh(f, 0.0) for f in c.features)
            after, come = {}, {}
            for tag in (True, False):
                scores = {p: v + sum(weigh(f, 0.0) for f in _move(p, tag, c.shape, c.lone)) for p, v in best.items()}
                come[tag] = max(scores, key=scores.__getitem__)
                after[tag] = scores[come[tag]] + (seen if tag else 0.0)
            back.append(come)
            best = after
        tags = []
        tag = max(best, key=best.__getitem__)
        for come in reversed(back):
            tags.append(tag)
            tag = come[tag]
        return tags[::-1]


def _counts(found: list[Candidate], tags: list[bool]) -> dict[str, int]:
    out: dict[str, int] = {}
    before = True
    for c, tag in zip(found, tags):
        for f in (*(c.features if tag else ()), *_move(before, tag, c.shape, c.lone)):
            out[f] = out.get(f, 0) + 1
        before = tag
    return out


def train(examples: list[tuple[str, set[int]]], epochs: int = 12) -> BoundaryModel:
    """Averaged structured perceptron."""
    weights: dict[str, float] = {}
    total: dict[str, float] = {}
    step = 0
    sequences = [(found, [c.end in cuts for c in found]) for found, cuts in ((candidates(text), cuts) for text, cuts in examples) if found]
    for _ in range(epochs):
        for found, right in sequences:
            step += 1
            guess = BoundaryModel(weights).decode(found)
            if guess == right:
                continue
            wanted, had = _counts(found, right), _counts(found, guess)
            for f in wanted.keys() | had.keys():
                change = wanted.get(f, 0) - had.get(f, 0)
                if change:
                    weights[f] = weights.get(f, 0.0) + change
                    total[f] = total.get(f, 0.0) + change * step
    return BoundaryModel({f: v - total.get(f, 0.0) / (step + 1) for f, v in weights.items()})


@lru_cache(None)
def model() -> BoundaryModel:
    return train(_examples())


def split_text(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, positions from 1, both inclusive."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    at = 0
    pieces = []
    for m in BLOCK.finditer(text):
        pieces.append((at, m.start()))
        at = m.end()
    pieces.append((at, len(text)))
    tagger = model()
    for start, end in pieces:
        block = text[start:end]
        if ITEM.match(block):  # an item is its line; what follows on other lines isn't part of it
            line = LINE_END.search(block, len(block) - len(block.lstrip()))
            if line:
                _emit(out, text, start, start + line.start())
                start += line.end()
                block = text[start:end]
            else:
                _emit(out, text, start, end)
                continue
        found = candidates(block)
        begin = 0
        for candidate, tag in zip(found, tagger.decode(found)):
            if tag:
                _emit(out, text, start + begin, start + candidate.end)
                begin = candidate.end
        _emit(out, text, start + begin, end)
    return out


def _emit(out: list[tuple[int, int]], text: str, a: int, b: int) -> None:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    if a < b:
        out.append((a + 1, b))


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, start_pos bigint, end_pos bigint`` of every sentence.

    Positions count characters from 1 and are those of the first and the last non-blank character. Null,
    empty and blank texts give no row; repeated rows give their sentences each. Texts are read whole.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans = [], []
            for value in batch.column(1).to_pylist():
                found = split_text(value)
                counts.append(len(found))
                spans += found
            rows = np.repeat(np.arange(batch.num_rows), counts)
            both = np.array(spans, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(both[:, 0]), pa.array(both[:, 1])], names=[key, "start_pos", "end_pos"])

    return df.select(F.col(key), F.col(text)).filter(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, start_pos bigint, end_pos bigint")


def p10_found(spark, sf_dir):
    return sentences(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text")


QUERIES = {"p10_found": p10_found}
SQL: dict[str, str] = {}
