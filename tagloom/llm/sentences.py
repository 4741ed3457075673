"""Sentence boundaries by cascading tables of break and no-break rules.

A place where a sentence may end is a run of closing marks with the quotes and brackets that follow it, a line end, a wide gap or a closing word of Thai.
Every place is decided by pairs of regular expressions (before, after) in order, the first pair that matches decides: the layout table (lines, lists, blank lines,
enclosed places, names), then the tables of the languages that are written at the place, then the common table. Those are the languages whose
function words are most frequent in the sentence before the place (else right after it, else in its paragraph, else ``lang``), and those whose script occurs there, since texts mix languages
and ``lang`` may be wrong. Outside the tables there are only the places themselves and the matching of quotes and brackets, which takes a stack.

What the rules see of a place: before it the last two words, whole (a last word that no table names is read as its kind), after it the shape of what follows. Each distinct context is decided once.

Defined results: null, empty and blank texts give no row; offsets count code points of the text as it stands; units have no
white space at either end; texts of any length are read whole; repeated rows each give their sentences.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

BREAK, JOIN = True, False

# Marks and brackets of the scripts.
MARKS = ".!?…。！？｡．।॥؟۔‼⁇⁈⁉።။។։"
CLOSERS = "\"”’'»›」』｣）)】》〉]］｝}“"
PAIRS = {"(": ")", "（": "）", "[": "]", "「": "」", "｢": "｣", "『": "』", "«": "»", "„": "“", "“": "”", "《": "》", "【": "】", "‹": "›"}
WIDE = "぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
THAI = "ก-๛"

# What follows a place: an optional gap ("_"), then one of these signs; "<" before all if the place is inside quotes or brackets that close after it.
#   $ end  U capital word  l small letter  u the same in a paragraph without capitals  i identifier or version  9 digit  L letter without case  W kana or Han  o opening quote or bracket
#   d dash before a small letter  D dash  , mark that goes on  x other  q kana that goes on after a quotation  and for line ends: • list line  ¶ blank line
# What stands before a place that isn't a closing mark: ⏎ line end, after • in a list line, after W behind kana or Han, after ∅ in a paragraph without closing marks; ⇥ wide gap.
_AFTER = re.compile(
    r"(?P<gap>\s*)(?:(?P<end>$)|(?P<i>v\d|[a-z]+[\w.-]*[_\d]\w*|[a-z]+_\w)|(?P<d>[—–-]\s*[^\W\d_A-ZА-ЯÀ-ÖØ-Þ])|(?P<D>[—–-])|(?P<o>[\"“„«‹「『｢（(【《\[¿¡'‘])"
    rf"|(?P<c>[,;:،؛、，；：])|(?P<n>\d)|(?P<W>[{WIDE}])|(?P<w>[^\W\d_]))?"
)

#: Characters after a place whose words tell its language where the sentence before it doesn't.
NEAR = 40

Rule = tuple[bool, str, str]
#: Words that rules name; all others of four letters and more look alike to them.
NAMED: set[str] = set()


def words(listed: str, any_case: bool = True) -> str:
    """The pattern of abbreviations that end in a full stop."""
    found = listed.split()
    NAMED.update(w.lower() for w in found)
    return rf"(?{'i' if any_case else ''}:(?<![A-Za-zÀ-ӿ0-9])(?:{'|'.join(map(re.escape, found))})\.$)"


def named(listed: str) -> str:
    """The pattern of words that a rule looks for before the last one."""
    NAMED.update(listed.split())
    return rf"(?i:{'|'.join(listed.split())})"


#: The cascade. Before is searched at the end of the last two words, after matched at the start of the shape.
TABLES: dict[str, list[Rule]] = {
    "layout": [
        (BREAK, r"•⏎$|⏎$", r"¶"),  # blank lines end everything
        (BREAK, r"•⏎$", r""),  # a list line is a unit
        (BREAK, r"⏎$", r"•"),
        (BREAK, r"∅⏎$", r""),  # line ends where no marks are
        (JOIN, r"", r"<"),  # what a sentence quotes or encloses doesn't end it
        (BREAK, r"W⏎$", r""),  # line ends where no gap is written between words
        (JOIN, r"⏎$", r""),  # a wrapped line
        (BREAK, r"⇥$", r""),
        (JOIN, r"(?<![.])\.$", r"[li9x]"),  # inside a file name, version, number or address
    ],
    "en": [
        (JOIN, words("Mr Mrs Ms Dr Prof St Ft Mt Sgt Capt Col Gen Rev Hon Jr Sr Messrs", False), r"_[Uui9Lo]"),
        (JOIN, words("no nos fig figs ch p pp vol vols sec eq art ca est approx"), r"_?[9i]"),
        (JOIN, words("fig figs ch pp vol vols sec eq ca approx dept ed eds est"), r"_?[lu]"),
        (JOIN, words("vs cf viz incl excl resp approx ca"), r"_?[^$]"),
        (JOIN, r"(?:e\.\s?g|i\.\s?e)\.$", r"_?[^$]"),
        (JOIN, words("Co Inc Corp Bros", False), r"_(?:l|U)"),
        (BREAK, rf"(?:a|p)\.m\.$|U\.\s?[SK]\.$|{words('etc al Ltd', False)}", r"_?[UiLWo9D$]"),
        (JOIN, rf"(?:a|p)\.m\.$|U\.\s?[SK]\.$|{words('etc al Ltd', False)}", r""),
    ],
    "de": [
        (JOIN, rf"(?<![A-Za-zÀ-ӿ0-9]){named('im am die der das den dem zum zur vom beim bis ab seit und')} \d+\.$", r"_[Ulu]"),
        (JOIN, words("hr hrn fr st dr prof dipl ing vgl ca bzw ggf evtl inkl exkl zzgl sog hrsg"), r"_?[^$]"),
        (JOIN, words("geb gest", False), r"_?[^$]"),
        (JOIN, words("nr abb bd aufl kap str tab jh jhd max min mio mrd"), r"_?[9lui]"),
        (JOIN, rf"\d\s+{words('Mio Mrd', False)}", r"_U"),
        (JOIN, r"(?<![A-Za-zÀ-ӿ0-9])(?:z|d|u|s|o|i|a|v)\.(?: [A-Za-zÄÖÜäöü]\.)?$", r"_"),
        (JOIN, words("Co", False), r"_U"),
        (BREAK, rf"(?:{words('usw')}|(?:u\. ?Ä|u\. ?ä)\.$)", r"_?[UiLWo9D$]"),
    ],
    "fr": [
        (JOIN, words("mme mmes mlle mlles dr pr av bd"), r"_?[^$]"),
        (JOIN, words("MM", False), r"_U"),
        (JOIN, words("env fig art vol chap cf éd réf tél hab ex"), r"_?[9lui]"),
        (JOIN, words("cf env"), r"_?[^$]"),
        (JOIN, r"(?:c\.-à-d|p\. ?ex)\.$", r""),
    ],
    "es": [
        (JOIN, words("sr sra sres srta dr dra prof lic ing avda admón"), r"_?[^$]"),
        (JOIN, words("pág págs vol art fig núm aprox cap tel ej ud uds"), r"_?[9lui]"),
        (JOIN, r"(?:p\. ?ej|EE)\.$", r"_?[^$]"),
        (BREAK, r"UU\.$", r"_[Uo$]"),
        (JOIN, r"UU\.$", r""),
    ],
    "ru": [
        (BREAK, r"и (?:т\. ?д|т\. ?п|др|пр)\.$|т\. [дп]\.$", r"_?[UiLWo9D$]"),
        (JOIN, r"т\. ?[дп]\.$", r""),
        (JOIN, words("см стр ок рис гл табл им ул тыс млн млрд руб напр ср изд проф акад гг вв т п ч г с д е"), r"_?[^$]"),
    ],
    "ko": [(JOIN, words("No Vol p pp ver", False), r"_?9")],
    "ja": [(JOIN, words("No Vol p pp ver", False), r"_?9")],
    "zh": [(JOIN, words("No Vol p pp ver", False), r"_?9")],
    "hi": [(JOIN, r"(?:^|\W)(?:डॉ|सं|श्री|पृ|प्रो|कं|रु|क्र)\.$", r"")],
    "ar": [(JOIN, r"(?:^|\W)(?:د|أ|م|ص|ج|هـ|ق|ت)\.$", r"")],
    "th": [
        (JOIN, r"(?:^|[\s\d])(?:น|ดร|พ\.ศ|ค\.ศ|ม\.ค|ก\.พ|รศ|ผศ|ศ|จ|อ|ต)\.$", r""),
        # closing words, after which a sentence ends though no mark is written; not if they are doubled
        (JOIN, r"(?:ครับ|ค่ะ|คะ)$", r"ๆ"),
        (BREAK, r"(?:ครับ|ค่ะ|คะ)$", r"_[^$]|[LUul]"),
    ],
    "common": [
        (JOIN, r"(?:…|\.\.)$", r"_?[lidLW,]"),  # an ellipsis within a sentence
        (BREAK, r"(?:…|\.\.)$", r"_u"),
        (JOIN, r"[…。！？]$", r"[,]"),
        (JOIN, r"", r"_?[,d]"),
        # speech that the sentence goes on after
        (JOIN, r"[.!?…。！？।؟][\"”»“’'」』｣›]+$", r"_?[lu]"),
        (JOIN, r"[。！？…][”」』｣\"]+$", r"[ULWi9]"),
        (JOIN, r"[가-힣][.!?][\"”’']+$", r"[L]"),
        (JOIN, r"[。！？…][”」』｣]+$", r"_?(?:q)"),
        (BREAK, r"[。！？｡！？।॥‼⁇⁈⁉።။][^.]*$", r""),
        # initials and single letters
        (JOIN, r"(?<![A-Za-zÀ-ӿ0-9])[A-Za-zÀ-ӿ]\.$|(?:^|\W)[^\W\d_]\.$", r"_?[UlLiW9oDu]"),
        (JOIN, r"(?<![A-Za-zÀ-ӿ0-9])(?:[^\W\d_]\.){2,}$", r"_?[lLi9u]"),
        # a full stop inside a name, number or path
        (BREAK, r"[^\W\d_]{2,}[\"”»)’]*[.!?…]+[\"”»“)\]’']*$", r"[ULo]"),
        (BREAK, r"[\d\"”»)%][.!?…]+[\"”»“)\]’']*$", r"[UL]"),
        (BREAK, r"[!?؟]+[\"”»“)\]’']*$", r"[UoLiW9]"),
        (BREAK, r"[^\W\d_]{3,}[!?.]+$", r"v"),
        (BREAK, r"", r"_[$UiLWo9Dxu]|\$"),
        (JOIN, r"", r""),
    ],
}
# Frequent function words (and unmistakable abbreviations) of the languages in Latin letters, and scripts of the others.
FUNCTION_WORDS = {
    "en": "i the a an of and to in is are was were it he she they we you i this that these with for on not his her at by from as or be has had will but what who which when where do does did said its our their my your there here so if up out into all only also than then mr mrs ms",
    "de": "der die das und ist nicht ein eine einen einem einer im am zu zum zur den dem des mit auf für von vom sich es er sie wir ich auch als wie aus bei nach noch nur oder aber war sind hat werden wird dass man über vor durch unter alle wurde dieser diese dieses bleibt um wurden steht bitte nr vgl bzw hr hrn",
    "fr": "le la les de des l d n qu et est soit y en me lui si leurs un une dans du au aux pour que qui sur avec il elle nous vous ne pas ce cette ces se son sa ses par plus ou mais dont leur sont été quelle quel à où être fait comme tout mme mlle voir",
    "es": "el la los las de que y en un una es por con para se su lo del al como más pero sus le ya o este esta estos son fue sin sobre también me hasta hay donde quien desde todo nos qué cuando muy no sr sra srta dra",
}
SCRIPTS = {"ru": "Ѐ-ӿ", "ko": "가-힣", "ja": "぀-ヿ", "zh": "一-鿿", "hi": "ऀ-ॿ", "ar": "؀-ۿ", "th": THAI}

_OF_LANGUAGE: dict[str, tuple[str, ...]] = {}
for _lang, _listed in FUNCTION_WORDS.items():
    for _word in _listed.split():
        _OF_LANGUAGE[_word] = (*_OF_LANGUAGE.get(_word, ()), _lang)

_LINE = re.compile(r"[^\r\n  ]*(?:\r\n|[\r\n  ]|$)")
_BULLET = re.compile(r"\s*[-*•‣·◦▪–]\s+\S")
# Where a place may start, and what it is, by its first character; a single set is what the search is fastest for.
_MARK = re.compile(rf"[{re.escape(MARKS)}]+(?:[\u00a0\u202f ]?[»›]|[{re.escape(CLOSERS)}])*")
_STARTS = re.compile(rf"[{re.escape(MARKS)}ค\r\n\u2028\u2029\u3000]")
_OTHER = re.compile(r"(?P<word>ครับ|ค่ะ|คะ)|(?P<line>\r\n|[\r\n\u2028\u2029])|(?P<wide>(?<=\S)\u3000+)")
_OPENS = re.compile("[" + re.escape("".join(set(PAIRS) | set(PAIRS.values())) + '"') + "]")
_FIRM = re.compile(r"[!?…。！？｡।॥؟۔‼⁇⁈⁉።။។:.]")
_WORDS = re.compile(r"[^\W\d_]+")
_LAST_WORD = re.compile(r"(?<![A-Za-zÀ-ӿ0-9])[A-Za-zÀ-ӿ]{4,}$")
_FILE_END = re.compile(r"[\d_]\S*?([^A-Za-z][A-Za-z]{2,})[^\w\s]*$")
_TAIL = re.compile(r"[A-Za-zÀ-ӿ]+$")
_NUMBER = re.compile(r"\W*\d+\W+$")
_WIDE_WORD = re.compile(rf"([가-힣]{{3}})|[{WIDE}]{{3}}")
_IS_WIDE = re.compile(f"[{WIDE}]")


def languages() -> list[str]:
    return [k for k in TABLES if k not in ("layout", "common")]


_RULES = {k: [(b, re.compile(x), re.compile(y)) for b, x, y in rules] for k, rules in TABLES.items()}
_IN_SCRIPT = {k: re.compile(f"[{chars}]") for k, chars in SCRIPTS.items()}


def _first(table: str, before: str, after: str) -> bool | None:
    return next((b for b, x, y in _RULES[table] if y.match(after) and x.search(before)), None)


def written_in(before: str, near: str, paragraph: str, own: str) -> tuple[str, ...]:
    """The languages whose tables hold at a place, by the words of the sentence before it, else those right after it, else those of its paragraph; ``own`` if there is no sign of any in Latin letters."""
    score: Counter = Counter()
    for part in (before, near, paragraph):
        for word in _WORDS.findall(part.lower()):
            for lang in _OF_LANGUAGE.get(word, ()):
                score[lang] += 1
        if max(score.values(), default=0) >= 2 or score and part is near:
            break
    most = max(score.values(), default=0)
    latin = [k for k, n in score.most_common() if 2 * n > most] if most else [own] if own in FUNCTION_WORDS else []
    found = sorted(latin, key=lambda k: (-score[k], k != own, k)) + [k for k, chars in _IN_SCRIPT.items() if chars.search(before) or chars.search(near)]
    return tuple(sorted(found, key=lambda k: k != own))


class Segmenter:
    """The cascade for texts said to be in one language, with its decided contexts."""

    def __init__(self, lang: str):
        self.lang = lang
        self.known: dict[tuple[str, str], tuple[dict[str, bool], bool]] = {}
        self.shapes: dict[tuple[str, str], bool | None] = {}

    def layout(self, sign: str, after: str) -> bool | None:
        """The first layout rule that matches, which looks only at the sign that stands at the place."""
        key = (sign, after)
        if key not in self.shapes:
            self.shapes[key] = _first("layout", sign, after)
        return self.shapes[key]

    def decide(self, before: str, after: str, langs) -> bool:
        """The first language or common rule that matches. ``langs()`` names the languages at the place; it is asked only if a language's table has a rule for the context."""
        found = self.known.get((before, after))
        if found is None:
            by_language = {k: d for k in languages() if (d := _first(k, before, after)) is not None}
            common = bool(_first("common", before, after))
            found = (by_language if any(d != common for d in by_language.values()) else {}, common)  # else the languages needn't be known
            if len(self.known) < 200_000:
                self.known[before, after] = found
        by_language, common = found
        if by_language:
            for lang in langs():
                if lang in by_language:
                    return by_language[lang]
        return common

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Offsets of the sentences of a text."""
        start, before = 0, ""  # of the open paragraph, and the kind of its last line
        for m in _LINE.finditer(text):
            a, b = m.span()
            if a == b:
                continue
            line = text[a:b]
            kind = "¶" if not line.strip() else "•" if _BULLET.match(line) else "x"
            if a > start and self.layout(before + "⏎", kind):
                yield from self._paragraph(text, start, a)
                start = a
            before = kind if kind == "•" else ""
        yield from self._paragraph(text, start, len(text))

    def _paragraph(self, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
        body = text[start:end]
        if not body.strip():
            return
        if _BULLET.match(body):  # ends with its line, so it is one unit
            yield _trim(text, start, end)
            return
        pairs = _pairs(body)
        opens, reach = [o for o, _ in pairs], list(accumulate((c for _, c in pairs), max))
        small = body.lower() == body
        cuts, marked, lines = [], False, []
        place = 0

        def langs() -> tuple[str, ...]:
            return written_in(body[cuts[-1] if cuts else 0 : place], body[place : place + NEAR], body, self.lang)

        done = 0
        for found in _STARTS.finditer(body):
            a = found.start()
            if a < done:
                continue
            kind = "mark"
            m = _MARK.match(body, a)
            if m is None:
                m = _OTHER.match(body, a)
                if m is None:
                    continue
                kind = m.lastgroup
            b = done = m.end()
            if kind == "line":
                lines.append((a, b))
                continue
            if kind == "mark":
                b = _own_closers(body, a, b, pairs)
            place = b
            after = ("<" if _enclosed(opens, reach, a, b) else "") + _after(body, b, small)
            sign = m.group() if kind != "wide" else "⇥"
            ends = self.layout(body[a:b] if kind == "mark" else sign, after)
            if kind == "word" and body[b : b + 1] == "ๆ":
                after = "ๆ"
            if ends is None:
                ends = self.decide(_before(body, a, b) if kind == "mark" else sign, after, langs)
            if ends:
                cuts.append(a if kind == "wide" else b)
                marked |= kind == "mark"
            elif kind == "mark" and after[0] != "<" and not body[b:].strip() and _FIRM.search(body[a:b]):
                marked = True
        for a, b in lines:
            sign = ("W" if a and _IS_WIDE.match(body, a - 1) else "") + ("" if marked else "∅") + "⏎"
            if self.layout(sign, "<" if _enclosed(opens, reach, a, b) else "x"):
                cuts.append(a)
        last = 0
        for cut in [*sorted(cuts), len(body)]:
            if cut > last:
                a, b = _trim(body, last, cut)
                if a < b:
                    yield start + a, start + b
                last = cut


def _enclosed(opens: list[int], reach: list[int], a: int, b: int) -> bool:
    """Whether a pair that opened before a closes after b."""
    before = bisect_left(opens, a)
    return bool(before) and reach[before - 1] >= b


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    part = text[a:b]
    left = len(part) - len(part.lstrip())
    return a + left, a + max(left, len(part.rstrip()))


def _pairs(body: str) -> list[tuple[int, int]]:
    """Matched quotes and brackets (open, close), by place of opening. A straight quote right after a Latin letter or a digit opens nothing (5" wide)."""
    stack: list[tuple[str, int]] = []
    found, straight = [], None
    for m in _OPENS.finditer(body):
        c, i = m.group(), m.start()
        if c == '"':
            if straight is not None:
                found.append((straight, i))
                straight = None
            elif not (i and body[i - 1].isascii() and body[i - 1].isalnum()):
                straight = i
        elif stack and PAIRS[stack[-1][0]] == c:
            found.append((stack.pop()[1], i))
        elif c in PAIRS:
            stack.append((c, i))
        else:  # closes something further out, or nothing
            for n in range(len(stack) - 1, -1, -1):
                if PAIRS[stack[n][0]] == c:
                    found.append((stack[n][1], i))
                    del stack[n:]
                    break
    if len(found) > 1:
        found.sort()
    return found


def _own_closers(body: str, a: int, b: int, pairs: list[tuple[int, int]]) -> int:
    """Takes back closers that open something instead (a straight quote or “ that starts the next sentence)."""
    for i in range(a, b):
        if body[i] in '"“«':
            n = bisect_left(pairs, (i, 0))
            if n < len(pairs) and pairs[n][0] == i:
                return len(body[:i].rstrip()) if i > a else b
    return b


def _before(body: str, a: int, b: int) -> str:
    """What rules may look at before b: the last two words, whole; of a word that no rule names only its kind, for which no rule looks at the word before."""
    marks = body[a:b]
    if marks[0] != ".":  # rules name no words before other marks, only kinds of signs
        return "".join("가" if "가" <= c <= "힣" else "a" if c.isalpha() else "9" if c.isdigit() else c for c in body[max(0, a - 3) : a]) + marks
    plain = _LAST_WORD.search(body, max(0, a - 64), a)
    if plain and len(plain[0]) < 64 and plain[0].lower() not in NAMED:
        return "word" + marks
    if a > 2 and (kind := _WIDE_WORD.match(body, a - 3, a)):
        return ("가가가" if kind[1] else "一一一") + marks
    end = a
    while end and not body[end - 1].isspace():
        end -= 1
    last = body[end:b]
    if name := _FILE_END.search(last):  # of a name with digits or underscores its last run of letters
        return name[1] + marks
    if body[a - 1 : a].isdigit():
        if not _NUMBER.match(last):
            return "a9" + marks
        last = "9" + marks
    start = len(body[:end].rstrip()) if end else 0
    first = start
    while first and not body[first - 1].isspace():
        first -= 1
    earlier = body[first:start]
    if (word := _TAIL.search(earlier)) and word[0].lower() in NAMED:
        return f"{word[0]} {last}"
    if earlier and len(earlier) < 5 and earlier[-1] == ".":
        return f"{earlier} {last}"
    return ("9 " if earlier[-1:].isdigit() else "x ") + last if earlier else last


def _after(body: str, b: int, small: bool) -> str:
    m = _AFTER.match(body, b)
    gap = "_" if m.end("gap") > m.start("gap") else ""
    kind = m.lastgroup
    if kind in (None, "gap"):
        return gap + "x"
    if kind == "end":
        return "$"
    if kind == "w":
        c = m.group("w")
        return gap + ("U" if c.isupper() else "u" if c.islower() and small and gap else "l" if c.islower() else "L")
    if kind == "W":
        return gap + ("q" if m.group("W") in "とって" else "W")
    return gap + {"c": ",", "n": "9"}.get(kind, kind)


def _segmenter(with_text: bool):
    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools: dict[str, Segmenter] = {}
        for batch in batches:
            ids, texts, langs = (batch.column(i) for i in range(3))
            starts, ends, rows, said = [], [], [], []
            for i, (text, lang) in enumerate(zip(texts.to_pylist(), langs.to_pylist())):
                if not text:
                    continue
                code = (lang or "").strip().lower()[:2]
                code = code if code in _RULES and code not in ("layout", "common") else ""
                if (tool := tools.get(code)) is None:
                    tool = tools[code] = Segmenter(code)
                for a, b in tool.spans(text):
                    rows.append(i)
                    starts.append(a)
                    ends.append(b)
                    if with_text:
                        said.append(text[a:b])
            columns = {"id": ids.take(pa.array(rows, pa.int64())), "sent_start": pa.array(starts, pa.int32()), "sent_end": pa.array(ends, pa.int32())}
            yield pa.RecordBatch.from_pydict(columns | ({"sentence": pa.array(said, pa.string())} if with_text else {}))

    return segment


def sentences(docs: DataFrame, doc: str, text: str, lang: str, with_text: bool = False) -> DataFrame:
    """(doc, sent_start, sent_end) of every sentence, with its text (sentence) if asked for."""
    kind = docs.schema[doc].dataType.simpleString()
    found = docs.select(doc, text, lang).mapInArrow(_segmenter(with_text), f"id {kind}, sent_start int, sent_end int" + ", sentence string" * with_text)
    return found.withColumnRenamed("id", doc)
