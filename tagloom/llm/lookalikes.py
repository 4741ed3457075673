"""Visually identical text with different characters: one form for texts that look the same.

Steps: delete what is invisible, compatibility normalization (NFKC, but superscripts and subscripts stay, since x² doesn't look like x2), join
accents with their letters; then read each word as a lattice, every character of a look-alike class standing for all members of its class,
and take the best path by Viterbi. Path scores are bigrams of the whole corpus plus a charge for a change of script inside a
word. The lattice holds classes only, never which member was typed, so all look-alikes of a word get the same form; of a class it holds the members that the corpus uses.

Classes come from Unicode's confusables (UTS 39) as ICU has them, which is part of every Spark, cut down to what a reader can't tell apart: characters of one prototype and one case, and of each
script only one letter, since readers do tell letters of their script apart (ค and ด, 土 and 士). A short list adds what usual fonts draw alike within a script.

Bigrams count characters of a look-alike class as themselves and all others by script, so the model has a bounded size whatever the
corpus. Defined results: a null text has a null form; case, accents, letters and gaps between words make a difference; an empty or invisible text
has the form ''; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import salted_join

# Characters that look the same in usual fonts, also within a script or between kana and Han; each line is one class, the first member's script comes first.
CLASSES = """
A А Α
B В Β
C С Ϲ
E Е Ε
H Н Η
I І Ι Ӏ
J Ј Ϳ
K К Κ
M М Μ
N Ν
O О Ο Օ
P Р Ρ
Q Ԛ
S Ѕ Տ
T Т Τ
W Ԝ
X Х Χ
Y У Υ Ү
Z Ζ
a а ɑ
c с ϲ
d ԁ
e е
g ɡ
h һ հ
i і ı
j ј ϳ
l ӏ
o о ο օ
p р
q ԛ
s ѕ
u ս
v ν ѵ
w ԝ
x х
y у
Г Γ
П Π
Ф Φ
カ 力
エ 工
ロ 口
ト 卜
タ 夕
ハ 八
ニ 二
ヘ へ
ー 一
ノ 丿
"""
#: Log score charged for a change of script between neighbouring letters of a word.
SWITCH = 8.0

_MEMBERS = [tuple(line.split()) for line in CLASSES.strip().splitlines()]
#: Class of each character: the list alone; :func:`confusables` adds Unicode's.
Classes = dict[str, tuple[str, ...]]
LISTED: Classes = {c: members for members in _MEMBERS for c in members}


@lru_cache(maxsize=65536)
def _script(c: str) -> str:
    name = unicodedata.name(c, "OTHER").split()[0]
    return {"CJK": "HAN", "KATAKANA-HIRAGANA": "KATAKANA", "DIGIT": "COMMON"}.get(name, name)


def _side(c: str) -> str:
    """Scripts that go together within a word count as one."""
    s = _script(c)
    return "KANA" if s in ("KATAKANA", "HIRAGANA") else s


@lru_cache(maxsize=65536)
def _plain(c: str) -> str:
    """What is left of a character: '' if invisible, a space for any gap, else its compatibility form."""
    code, cat = ord(c), unicodedata.category(c)
    if c.isspace() or cat in ("Zs", "Zl", "Zp") or code == 0x2800:
        return " "
    if cat in ("Cf", "Cc") or code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or 0x180B <= code <= 0x180F:
        return ""
    tag = unicodedata.decomposition(c).partition(" ")[0]
    if tag[:1] != "<" or tag in ("<super>", "<sub>") or 0x3130 <= code <= 0x318F:  # single Korean letters would join into syllables
        return c
    plain = unicodedata.normalize("NFKC", c)
    return c if plain[0] == " " else plain  # an accent that stands alone


def _kind(c: str, prototype: str) -> str:
    """Upper case, lower case, letters without case (by the letter they look like) and each sort of punctuation are kinds of their own."""
    cat = unicodedata.category(c)
    if cat in ("Lo", "Lm") and len(prototype) == 1 and unicodedata.category(prototype) in ("Lu", "Ll"):
        cat = unicodedata.category(prototype)
    return {"Lt": "Lu", "Lm": "Lo"}.get(cat, cat)


@lru_cache(maxsize=1)
def _unicode_classes(skeletons: tuple[tuple[str, str], ...]) -> Classes:
    groups: dict[tuple[str, str], list[str]] = {}
    for c, prototype in skeletons:
        groups.setdefault((prototype, _kind(c, prototype)), []).append(c)
    grown: dict[tuple[str, ...], list[str]] = {members: list(members) for members in _MEMBERS}
    rest: list[tuple[str, ...]] = []
    for (_, kind), members in groups.items():
        one: dict[str, str] = {}
        for c in members:  # by code point, so that a script's usual letter comes before its rare ones
            one.setdefault(_script(c) if kind[0] == "L" else "ASCII" if c.isascii() else c, c)
        base = next((LISTED[c] for c in one.values() if c in LISTED), None)
        free = sorted((c for c in one.values() if c not in LISTED), key=lambda c: (not c.isascii(), _script(c) != "LATIN", ord(c)))
        if base is not None:
            scripts = set(map(_script, grown[base]))
            grown[base] += [c for c in free if _script(c) not in scripts]
        elif len(free) > 1:
            rest.append(tuple(free))
    return {c: members for members in [*map(tuple, grown.values()), *rest] for c in members}


def confusables(spark: SparkSession) -> Classes:
    """The classes of all letters and punctuation, from the ICU library of the session's JVM; one call, a table of about a thousand characters."""
    chars = [c for c in map(chr, range(0x21, 0x30000)) if unicodedata.category(c)[0] in "LP" and not unicodedata.decomposition(c)]
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    return _unicode_classes(tuple(zip(chars, checker.getSkeleton("\n".join(chars)).split("\n"))))


def visible(text: str) -> str:
    """A text without invisible characters and differences of width, fully decomposed."""
    if text.isascii() and text.isprintable():
        return " ".join(text.split())
    text = unicodedata.normalize("NFC", "".join(map(_plain, text)))
    return unicodedata.normalize("NFD", " ".join(text.split()))


def bigrams(word: str, classes: Classes = LISTED) -> Iterator[tuple[str, str]]:
    last = "^"
    for c in word:
        if unicodedata.combining(c):
            continue
        now = c if c in classes else _script(c)
        yield last, now
        last = now


class Model:
    """Bigram scores and the look-alike lattice."""

    def __init__(self, counts: dict[tuple[str, str], int], classes: Classes = LISTED):
        first: Counter = Counter()
        for (a, _), n in counts.items():
            first[a] += n
        size = len({b for _, b in counts}) + 1
        self.known = {k: math.log((n + 0.1) / (first[k[0]] + 0.1 * size)) for k, n in counts.items()}
        self.unseen = {a: math.log(0.1 / (n + 0.1 * size)) for a, n in first.items()}
        self.floor = math.log(1 / size)
        self.classes = classes
        used = {b for _, b in counts}
        self.options = {members: tuple(c for c in members if c in used) or members[:1] for members in set(classes.values())}
        self.words: dict[str, str] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "words": {}}

    def _score(self, a: str, b: str) -> float:
        found = self.known.get((a, b))
        return self.unseen.get(a, self.floor) if found is None else found

    def word(self, word: str) -> str:
        """The best reading of a decomposed word; look-alike words give the same."""
        skeleton = "".join(self.classes[c][0] if c in self.classes else c for c in word)
        found = self.words.get(skeleton)
        if found is None:
            found = unicodedata.normalize("NFC", self._viterbi(skeleton))
            if len(self.words) < 100_000:
                self.words[skeleton] = found
        return found

    def _viterbi(self, word: str) -> str:
        paths: list[tuple[float, str, str, str]] = [(0.0, "^", "", "")]  # score, symbol, side, text
        for c in word:
            if unicodedata.combining(c):
                paths = [(s, a, side, t + c) for s, a, side, t in paths]
                continue
            ahead = []
            for option in self.options[self.classes[c]] if c in self.classes else (c,):
                now, here = option if option in self.classes else _script(option), _side(option) if option.isalpha() else ""
                best = max(paths, key=lambda p: p[0] + self._score(p[1], now) - (SWITCH if p[2] and here and p[2] != here else 0.0))
                score = best[0] + self._score(best[1], now) - (SWITCH if best[2] and here and best[2] != here else 0.0)
                ahead.append((score, now, here or best[2], best[3] + option))
            paths = ahead
        return max(paths, key=lambda p: p[0])[3]

    def form(self, text: str | None) -> str | None:
        return None if text is None else " ".join(map(self.word, visible(text).split(" ")))


_LETTERS = re.compile(r"[^\W\d_]")


def train(texts: DataFrame, column: str) -> Model:
    """Bigrams of all words of the distinct texts; counted per partition first, then summed. At most (members + scripts) ^ 2 rows reach the driver."""
    classes = confusables(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word in visible(text).split(" "):
                    if _LETTERS.search(word):
                        seen.update(bigrams(word, shared.value))
        if seen:
            keys = list(seen)
            yield pa.RecordBatch.from_pydict({"a": [k[0] for k in keys], "b": [k[1] for k in keys], "n": pa.array([seen[k] for k in keys], pa.int64())})

    pairs = texts.select(column).filter(F.col(column).isNotNull()).distinct().mapInArrow(count, "a string, b string, n bigint")
    return Model({(r["a"], r["b"]): r["n"] for r in pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}, classes)


def forms(rows: DataFrame, column: str, model: Model, out: str = "form") -> DataFrame:
    """Adds the one form of each text; words are cached by their look-alike skeleton."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def form(series):
        return series.map(shared.value.form, na_action="ignore").astype(object)

    return rows.withColumn(out, form(F.col(column)))


def classes_of(rows: DataFrame) -> DataFrame:
    """(field_name, form, n_rows, n_texts) of every form: how many rows look like it and how many different texts they have; with the forms of the rows, this is the result that grows with the rows, not with their pairs."""
    per_text = rows.filter("form is not null").groupBy("field_name", "form", "text").agg(F.count("*").alias("n"))
    return per_text.groupBy("field_name", "form").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_texts"))


def same_looking_pairs(rows: DataFrame, hot_rows: int = 50_000) -> DataFrame:
    """(field_name, id_a, id_b) of rows (field_name, id, text, form) with equal forms and different texts, id_a < id_b.

    Only forms with several texts are joined. A form with more than ``hot_rows`` rows is split: its rows are salted on one side and repeated
    per salt on the other.
    """
    rows = rows.select("field_name", "id", "text", "form").filter("form is not null and id is not null").distinct()
    variants = rows.groupBy("field_name", "form", "text").agg(F.count("*").alias("n"))
    groups = variants.groupBy("field_name", "form").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).filter("texts > 1")
    groups = groups.select("field_name", "form", F.ceil(F.col("n") / hot_rows).cast("int").alias("salts"), F.col("n").alias("n_rows"))
    mine = salted_join(rows, groups, ["field_name", "form"], "id", "inner", hot_rows)
    left = mine.select("field_name", "form", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.col("id").alias("id_a"), F.col("text").alias("text_a"))
    right = mine.select("field_name", "form", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("id_b"), F.col("text").alias("text_b"))
    pairs = left.join(right, ["field_name", "form", "salt"]).filter("id_a < id_b and text_a <> text_b")
    return pairs.select("field_name", "id_a", "id_b")
