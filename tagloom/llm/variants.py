"""Variant spellings of names typed by people: metric-space partitioning and what no edit distance sees.

A typed name becomes points (a, b): given names and family name, both orders where the order isn't known, stem and type of an organisation,
or the joined parts of a Japanese or Korean name; honorifics, suffixes, look-alikes, accents and case are gone by then. Middle names and initials are part of a. The metric is
the sum of the true Damerau-Levenshtein distances of both parts.

Radius join: every point x has a radius r, and goes home to its nearest pivot h. It visits a pivot p if d(x, p) < d(x, h) + r, or if they are equal and p comes
after h, and d(x, p) <= R_p + r (R_p the largest home distance in p's cell). That is enough for two points within r of each other, x at home in h and y in p: by the
triangle inequality [d(x, p) - d(x, h)] + [d(y, h) - d(y, p)] <= 2 r, so one of them is below r or both are r, and then the one whose
other pivot comes later visits it. Persons, organisations of one kind, single words and names without gaps are spaces of their own. A cell is joined as a grid of
blocks of at most ``CELL`` home and visiting points; inside a block only points at about the same distance from the pivot are looked at, a letter-count bound and then the exact
metric decide, and only matches leave it. Entities are the connected components.

Three relations are no distance: a name with a middle name and the same without, an initial, a nickname. They are joined on the family name and what else
is given, only between entities, and only where exactly one fits; ``link_kinds`` counts them apart from the metric's links.

Defined results: null and blank texts fall back to the normalized text, then to the key; null and empty keys have no row; counters and names that end in a number by
itself (parts of a series) are no names; other names with digits and short names are points of radius 0, so only equal ones meet; repeated names count once; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.groups import connected
from tagloom.llm.lookalikes import LISTED, Classes, Model, _script
from tagloom.session import Scratch, salted_join

#: Largest distance that links two points; shorter names have less.
RADIUS = 2
#: Pivots at most, and points for each pivot squared; the first bounds what is sent to all tasks, the second the distances per point.
PIVOTS, PER_PIVOT = 16_384, 9
#: Home and visiting points of one block of a cell at most.
CELL = 4_000

# Words that surround a name without being part of it.
TITLES = {"dr", "mr", "mrs", "ms", "prof", "sir", "mme", "mlle", "herr", "frau"}
KINDS = ("studio", "circle", "atelier", "press", "archive", "pictures", "workshop", "collective", "group", "team", "productions", "company", "library", "gallery")
SHORT_KINDS = {"pics": "pictures", "pix": "pictures", "archives": "archive", "studios": "studio", "works": "workshop", "work": "workshop", "picture": "pictures"}
LEGAL = {"the", "co", "ltd", "inc", "llc", "kg", "gmbh", "corp"}
_TAIL = re.compile(r"(?:[\s_\-]+(?:official|artist|art|illust|illustrator|offical))+$|[\-_\s](?:san|sama|kun|chan|sensei)$", re.I)
_HEAD = re.compile(r"^(?:art|illust(?:ration)?|drawn|works?)?[\s_]*by[\s_]+", re.I)
_ASIAN_TAIL = re.compile(r"(?:さん|ちゃん|くん|さま|様|先生|氏)$|\s*(?:선생님|작가님|작가|님|씨)$")
_BRACKET = re.compile(r"[(\[（【].*?[)\]）】]")
_QUOTED = re.compile(r"[\"“”„«»「」『』]([^\"“”„«»「」『』]+)[\"“”„«»「」『』]")
_SPLIT = re.compile(r"[\s_・=･\-–]+")
_CAMEL = re.compile(r"(?<=[^\W\d_A-ZА-ЯÀ-ÖØ-Þ])(?=[A-ZА-ЯÀ-ÖØ-Þ])")
_COUNTER = re.compile(r"(?i)users?入り?$|(?:^|[\s_\-])\d+$")
_ASIAN = re.compile(r"[぀-ヿ㐀-鿿가-힣ᄀ-ᇿ]")


def _bare(word: str) -> str:
    """Case and accents off."""
    return "".join(c for c in unicodedata.normalize("NFD", word.casefold()) if not unicodedata.combining(c))


def _kind(word: str, dotted: bool) -> str | None:
    """The kind of organisation a word or its abbreviation names: letters left out, the first kept."""
    if word in KINDS or word in SHORT_KINDS:
        return SHORT_KINDS.get(word, word)
    if 3 <= len(word) <= 6 and (dotted or len(word) > 3 and sum(c in "aeiou" for c in word) <= 1):
        for kind in KINDS:
            rest = iter(kind)
            if word[0] == kind[0] and len(word) < len(kind) and all(c in rest for c in word):
                return kind
    return None


def _in_script(word: str, script: str, classes: Classes) -> str:
    """A lone letter in the script of the name it belongs to; alone it can't tell its own."""
    letter = word.strip(".'’")
    return next((c for c in classes.get(letter, ()) if _script(c) == script), letter) if len(letter) == 1 else word


def points(name: str | None, classes: Classes = LISTED) -> list[tuple[str, str, str]]:
    """(use, a, b) of a name: use 'm' joins by the metric, 'r' is a name with its middle names left out, 'i' an initial (and that of a middle name) with a family name, 'n' a quoted nickname with the given name."""
    if not name or _COUNTER.search(name.strip()):
        return []
    name = _HEAD.sub("", name.strip())
    if _ASIAN.search(name):
        return _asian(name)
    nick = _QUOTED.search(name)
    name = _TAIL.sub("", _BRACKET.sub(" ", _QUOTED.sub(" ", name)).strip(" _")).strip(" _")
    if "," in name:
        family, _, given = name.partition(",")
        words, ordered = [*_SPLIT.split(given.strip()), *_SPLIT.split(family.strip())], True
    else:
        words, ordered = _SPLIT.split(_CAMEL.sub(" ", name) if not _SPLIT.search(name) else name), False
    main = _script(max(words, key=len)[:1] or " ")
    words = [_in_script(w, main, classes) for w in words]
    marked = [(_bare(w.replace("/", "")).strip(".'’"), "." in w or "/" in w) for w in words]
    marked = [(w, dot) for w, dot in marked if w and w not in TITLES]
    kinds = [k for w, dot in marked if (k := _kind(w, dot))]
    if kinds:
        stem = "".join(w for w, dot in marked if not _kind(w, dot) and w not in LEGAL)
        return [("m", stem, "#" + kinds[-1])] if stem else []
    words = [w for w, _ in marked]
    if len(words) < 2:
        return [("m", words[0], "")] if words else []
    first, last, middle = words[0], words[-1], words[1:-1]
    if len(first) == 1 or len(last) == 1:
        if len(first) == 1 and not (len(last) == 1 and len(words) == 2):
            return [("i", " ".join([first, *(m[0] for m in middle)]), last)]
        return [("i", " ".join([w[0] for w in words[1:]]), first)]
    # given names before the family name, or after it
    orders = [(first, middle, last)] + ([] if ordered else [((middle or [last])[0], [*middle[1:], last] if middle else [], first)])
    out = [("m", " ".join([g, *mid]), f) for g, mid, f in orders]
    out += [("r", g, f) for g, mid, f in orders if mid]
    return out + ([("n", _bare(nick.group(1).strip()), first)] if nick else [])


def _asian(name: str) -> list[tuple[str, str, str]]:
    name = _BRACKET.sub("", name).strip(" _")
    plain = _ASIAN_TAIL.sub("", name)
    out = []
    for form in dict.fromkeys([plain, name]):
        parts = [p for p in _SPLIT.split(form) if p]
        for order in (parts, parts[1:] + parts[:1]) if len(parts) == 2 else (parts,):
            joined = unicodedata.normalize("NFD", "".join(order)) if any("가" <= c <= "힣" for c in form) else "".join(order)
            if joined:
                out.append(("m", joined, "~"))
    return out


def distance(a: str, b: str) -> int:
    """The true (unrestricted) Damerau-Levenshtein distance, a metric."""
    if a == b:
        return 0
    far = len(a) + len(b)
    last: dict[str, int] = {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        col = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), col
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, col = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[-1][-1]


def distances(words: np.ndarray, pivot: str) -> np.ndarray:
    """The same distance of many words (codes, one row each, 0 after the end) to one pivot, column by column over all words at once."""
    n, width = words.shape
    size = (words != 0).sum(1)
    p = len(pivot)
    codes = np.array([ord(c) for c in pivot], np.int32)
    far = np.int16(width + p)
    d = np.full((n, width + 2, p + 2), far, np.int16)
    d[:, 1:, 1] = np.arange(width + 1)
    d[:, 1, 1:] = np.arange(p + 1)
    rows = np.arange(n)
    last = np.zeros((n, p), np.int16)  # by place in the pivot: last row whose letter is the pivot's there
    for i in range(1, width + 1):
        letter = words[:, i - 1]
        same = letter[:, None] == codes[None, :]
        col = np.zeros(n, np.int16)
        for j in range(1, p + 1):
            k, eq = last[:, j - 1], same[:, j - 1]
            swap = d[rows, k, col] + (i - k - 1) + 1 + (j - col - 1)
            best = np.minimum(d[:, i, j] + ~eq, np.minimum(d[:, i + 1, j], d[:, i, j + 1]) + 1)
            d[:, i + 1, j + 1] = np.minimum(best, swap)
            col = np.where(eq, np.int16(j), col)
        last = np.where(same, np.int16(i), last)
    return d[rows, size + 1, p + 1]


def _codes(words: list[str]) -> np.ndarray:
    width = max(map(len, words), default=0)
    out = np.zeros((len(words), width), np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = [ord(c) for c in w]
    return out


@lru_cache(maxsize=200_000)
def _letters(word: str) -> int:
    """Letters with their counts as 64 bits; one edit changes at most two of them."""
    mask, seen = 0, {}
    for c in word:
        seen[c] = seen.get(c, 0) + 1
        mask |= 1 << ((ord(c) * 31 + seen[c] * 17) % 64)
    return mask


def allowed(a: str, b: str) -> int:
    """Edits a point may be away from a variant: less for short names, none for names with digits."""
    if any(c.isdigit() for c in a + b):
        return 0
    n = len(a) + (0 if b[:1] in "#~" else len(b))
    two, one = (7, 4) if b == "~" else (8, 5) if b[:1] == "#" else (10, 6)
    return 2 if n >= two else 1 if n >= one else 0


def space(b: str) -> str:
    """The space of a point; points of different spaces are never variants."""
    return b if b[:1] in ("#", "~", "") else "p"


def _near_words(a: str, x: str, d: int) -> bool:
    """Whether two words are near for their length."""
    n = min(len(a), len(x))
    return d <= (0 if n < 3 else 1 if n < 5 else 2)


def _linked(a: str, b: str, x: str, y: str, given: frozenset) -> bool:
    """Whether two points are variants: within both radii, word by word near for their length, with as many given names, and not two different known ones."""
    if space(b) != space(y):
        return False
    if b != y and b in given and y in given:
        return False
    mine, theirs = a.split(" "), x.split(" ")
    if len(mine) != len(theirs) or a != x and any(g != h and g in given and h in given for g, h in zip(mine, theirs)):
        return False
    room = min(allowed(a, b), allowed(x, y))
    for g, h in zip(mine, theirs):
        if g != h:
            d = distance(g, h)
            room -= d
            if room < 0 or not _near_words(g, h, d):
                return False
    if b == y:
        return True
    d = distance(b, y)
    return d <= room and _near_words(b, y, d)


def radius_links(names: DataFrame, given: list[str], scratch: Scratch, pivots: int = PIVOTS, cell: int = CELL) -> DataFrame:
    """(u, v) of the points (id, a, b), distinct, that are variants of each other, by the metric partition described above; u < v."""
    spark = names.sparkSession
    n = names.count()
    count = max(1, min(pivots, math.isqrt(n // PER_PIVOT)))
    # A pivot set of bounded size, the same on every run; which points are pivots changes the cells, not the links. Each space in it has one more as its own.
    chosen = [(r["a"], r["b"]) for r in names.orderBy(F.xxhash64("id"), "id").limit(count).collect()]
    spaces = F.when(F.substring("b", 1, 1).isin("#", "~", ""), F.col("b")).otherwise("p")
    firsts = names.groupBy(spaces.alias("space")).agg(F.min(F.struct("a", "b")).alias("p")).collect()  # as many as there are kinds of names, a fixed list
    chosen = list(dict.fromkeys(chosen + [(r["p"]["a"], r["p"]["b"]) for r in firsts]))
    sent = spark.sparkContext.broadcast((chosen, frozenset(given)))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, _ = sent.value
        of_space = np.array([space(b) for _, b in at], object)
        for frame in frames:
            for kind, part in frame.groupby(frame["b"].map(space), sort=False):
                mine = np.flatnonzero(of_space == kind)
                step = max(64, 4_000_000 // len(mine))
                for lo in range(0, len(part), step):
                    yield _placed(part.iloc[lo : lo + step], [at[k] for k in mine], mine)

    def _placed(part: pd.DataFrame, at: list[tuple[str, str]], number: np.ndarray) -> pd.DataFrame:
        d = np.zeros((len(part), len(at)), np.int16)
        for side, col in ((0, "a"), (1, "b")):
            words, back = np.unique(part[col].to_numpy(dtype=str), return_inverse=True)
            coded, done = _codes([str(w) for w in words]), {}
            for k, pivot in enumerate(at):
                if pivot[side] not in done:
                    done[pivot[side]] = distances(coded, pivot[side])
                d[:, k] += done[pivot[side]][back]
        room = np.array([allowed(a, b) for a, b in zip(part["a"], part["b"])], np.int16)
        home, least = d.argmin(1), d.min(1)
        edge = (least + room)[:, None]
        here = np.arange(len(at))[None, :]
        visits = (d < edge) | (d == edge) & (here > home[:, None]) | (here == home[:, None])
        row, to = np.nonzero(visits)
        out = part.iloc[row].reset_index(drop=True)
        return out.assign(pivot=number[to].astype(np.int32), d=d[row, to].astype(np.int32), r=room[row].astype(np.int32), is_home=home[row] == to)

    kind = names.schema["id"].dataType.simpleString()
    spread = max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
    # by a, so that points with the same given name are measured together
    placed = scratch.put(names.select("id", "a", "b").repartition(spread, "a").mapInPandas(measure, f"id {kind}, a string, b string, pivot int, d int, r int, is_home boolean"))
    cells = placed.groupBy("pivot").agg(F.max(F.when(F.col("is_home"), F.col("d"))).alias("reach"), F.count_if("is_home").alias("homes"), F.count("*").alias("visits"))
    cells = cells.filter("homes > 0").select("pivot", "reach", F.ceil(F.col("homes") / cell).cast("int").alias("h"), F.ceil(F.col("visits") / cell).cast("int").alias("v"))
    met = placed.join(F.broadcast(cells), "pivot").filter(F.col("d") <= F.col("reach") + F.col("r"))  # at most ``pivots`` rows
    salt = lambda by: F.pmod(F.xxhash64("id"), F.col(by)).cast("int")
    every = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    home = met.filter("is_home").select("pivot", salt("h").alias("i"), every("v").alias("j"), "id", "a", "b", "d", F.lit(True).alias("home"))
    visit = met.withColumn("j", salt("v")).select("pivot", every("h").alias("i"), "j", "id", "a", "b", "d", F.lit(False).alias("home"))

    def join(block: pd.DataFrame) -> pd.DataFrame:
        _, known = sent.value
        left, right = block[block["home"]], block[~block["home"]].sort_values("d", kind="stable")
        out: list[tuple] = []
        if len(left) and len(right):
            far = right["d"].to_numpy()
            masks = [np.array([_letters(w) for w in right[c]], np.uint64) for c in ("a", "b")]
            ids, ra, rb = right["id"].to_numpy(), right["a"].to_numpy(), right["b"].to_numpy()
            size = np.array([len(a) + len(b) for a, b in zip(ra, rb)], np.int16)
            for x, a, b, d in zip(left["id"], left["a"], left["b"], left["d"]):
                lo, hi = np.searchsorted(far, (d - RADIUS, d + RADIUS + 1))  # within the radius of each other the distances to the pivot differ no more
                bits = np.bitwise_count(masks[0][lo:hi] ^ np.uint64(_letters(a))) + np.bitwise_count(masks[1][lo:hi] ^ np.uint64(_letters(b)))
                for k in lo + np.flatnonzero((bits <= 2 * RADIUS) & (np.abs(size[lo:hi] - len(a) - len(b)) <= RADIUS)):
                    if x != ids[k] and _linked(a, b, ra[k], rb[k], known):
                        out.append((x, ids[k]) if x < ids[k] else (ids[k], x))
        return pd.DataFrame(out, columns=["u", "v"])

    return home.unionByName(visit).groupBy("pivot", "i", "j").applyInPandas(join, f"u {kind}, v {kind}").distinct()


def _one_entity(asked: DataFrame, persons: DataFrame, on: list[str]) -> DataFrame:
    """(u, v): the entity u of an asked name and the only entity v of persons (on..., entity) that its key leads to."""
    sure = persons.groupBy(*on).agg(F.min("entity").alias("v"), F.max("entity").alias("w")).filter("v = w").drop("w")
    return asked.join(sure, on).select(F.col("entity").alias("u"), "v").filter("u <> v").distinct()


def _merged(scratch: Scratch, links: DataFrame):
    """A function that gives a frame's entity column the label it has once the linked entities are one."""
    labels = connected(links, scratch).select(F.col("node").alias("__old"), "label")
    return lambda df: df.join(labels, F.col("entity") == F.col("__old"), "left").withColumn("entity", F.coalesce("label", "entity")).drop("__old", "label")


def _linked_parts(rows: DataFrame, key: str, texts: list[str], nicknames: DataFrame, model: Model) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(key, entity), and the links of each kind: metric between points, the others between entities."""
    spark: SparkSession = rows.sparkSession
    scratch = Scratch(spark, "variants")
    shared = spark.sparkContext.broadcast(model)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = shared.value
        for frame in frames:
            out = [(k, *p) for k, text in zip(frame["key"], frame["text"]) for p in points(tool.form(text), tool.classes)]
            yield pd.DataFrame(out, columns=["key", "use", "a", "b"])

    text = F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in texts], F.col(key))
    typed = rows.select(F.col(key).alias("key"), text.alias("text")).filter("key is not null and key <> ''").distinct()
    made = typed.mapInPandas(parse, "key string, use string, a string, b string").distinct()
    # A name without its middle name and the same name typed that way are one point.
    made = scratch.put(made.withColumn("id", F.concat_ws("\u0001", F.lit("n"), F.when(F.col("use") == "r", "m").otherwise(F.col("use")), "a", "b")))
    given_rows = nicknames.select("given_name", "nickname").distinct().collect()  # a fixed table of some hundred rows
    given = sorted({_bare(r["given_name"]) for r in given_rows if r["given_name"]})
    metric = scratch.put(made.filter("use in ('m', 'r')").select("id", "a", "b").distinct())
    near = scratch.put(radius_links(metric, given, scratch))
    belongs = made.filter("use in ('m', 'i')").select(F.concat_ws("\u0001", F.lit("k"), "key").alias("u"), F.col("id").alias("v"))
    entities = connected(scratch.put(belongs.unionByName(near)), scratch).withColumnRenamed("label", "entity")
    of_node = lambda df: df.join(entities, F.col("id") == F.col("node"), "left").withColumn("entity", F.coalesce("entity", "id")).drop("node")
    named = scratch.put(of_node(made.filter("use <> 'n'")).withColumns({"given": F.substring_index("a", " ", 1), "start": F.substring("a", 1, 1), "middle": F.when(F.contains("a", F.lit(" ")), F.substring_index(F.substring_index("a", " ", 2), " ", -1)).otherwise("")}))

    # Middle names: an initial stands for the one middle name it fits, and a name without any for the one person who has that given and family name.
    full = named.filter("use = 'm' and middle <> ''").select("key", "given", "middle", F.col("b").alias("family"), "entity")
    short = full.filter("length(middle) = 1").withColumnRenamed("middle", "start")
    spelt = full.filter("length(middle) > 1").withColumn("start", F.substring("middle", 1, 1))
    first = _one_entity(short, spelt, ["given", "family", "start"])
    reduced = named.filter("use = 'r'").select("key", F.col("given").alias("g"), F.col("b").alias("f"), F.col("entity").alias("bare"))
    joined = full.join(reduced, (full["key"] == reduced["key"]) & (F.col("given") == F.col("g")) & (F.col("family") == F.col("f"))).select("bare", "entity").distinct()
    apart = scratch.put(_merged(scratch, scratch.put(first))(joined).distinct())
    alone = apart.groupBy("bare").agg(F.min("entity").alias("v"), F.max("entity").alias("w")).filter("v = w and bare <> v").select(F.col("bare").alias("u"), "v")
    middles = scratch.put(first.unionByName(alone))
    named = scratch.put(_merged(scratch, middles)(named))

    persons = scratch.put(named.filter("use in ('m', 'r') and b <> '' and substr(b, 1, 1) not in ('#', '~')").select("given", "start", F.substring("middle", 1, 1).alias("mid"), F.col("b").alias("family"), "entity").distinct())
    is_given = F.col("given").isin(given)
    listed = spark.createDataFrame([(_bare(r["nickname"]), _bare(r["given_name"])) for r in given_rows if r["given_name"] and r["nickname"]] or [("", "")], "nick string, called string")
    quoted = made.filter("use = 'n'").select(F.col("a").alias("nick"), F.col("b").alias("called"))
    called = persons.filter(~is_given).select(F.col("given").alias("nick"), "family", "entity").join(listed.unionByName(quoted).distinct(), "nick")
    met = called.select(F.col("called").alias("given"), "family", F.col("entity").alias("u")).join(persons.select("given", "family", F.col("entity").alias("v")), ["given", "family"])
    nicks = scratch.put(met.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w")).filter("v = w and u <> v").drop("w"))
    # Nicknames that no list has: the start of a given name with a usual ending
    unlisted = persons.filter(F.col("given").rlike("^.{2,5}(ie|y|o|s)$") & ~is_given).select("family", "entity", F.regexp_extract("given", "^(.{2,4}?)(ie|y|o|s)$", 1).alias("begins"))
    known = persons.filter(is_given).select("family", "entity", F.explode(F.transform(F.array(*map(F.lit, (2, 3, 4))), lambda n: F.substr("given", F.lit(1), n))).alias("begins"))
    endings = scratch.put(_one_entity(unlisted, known, ["family", "begins"]))
    # Initials come after nicknames, so that a person and their nickname count as one
    settled = _merged(scratch, scratch.put(nicks.unionByName(endings)))
    started = scratch.put(settled(persons.select("family", "start", "mid", "entity")).distinct())
    initials = named.filter("use = 'i'").select(F.col("b").alias("family"), "start", F.col("middle").alias("mid"), "entity").distinct()
    both = _one_entity(initials.filter("mid <> ''"), started.filter("mid <> ''"), ["family", "start", "mid"])
    bare = started.groupBy("family", "start").agg(F.max("mid").alias("other")).filter("other = ''").drop("other")  # nobody there has a middle name
    one = _one_entity(initials.filter("mid = ''").select("family", "start", "entity"), started, ["family", "start"])
    two = _one_entity(initials.filter("mid <> ''").select("family", "start", "entity"), started.join(bare, ["family", "start"], "left_semi"), ["family", "start"])
    starts = scratch.put(both.unionByName(one).unionByName(two).distinct())
    final = _merged(scratch, scratch.put(nicks.unionByName(endings).unionByName(starts)))(named)
    linked = final.filter("use in ('m', 'i')").groupBy("key").agg(F.min("entity").alias("entity"))
    return linked, {"metric": near, "middle name": middles, "nickname": nicks, "nickname by its start": endings, "initial": starts}


def link_keys(rows: DataFrame, key: str, texts: list[str], nicknames: DataFrame, model: Model) -> DataFrame:
    """(key, entity) of every key that is a name; keys of one person or organisation share the entity.

    texts: the columns with the text a key was made from, the first that isn't blank counts, else the key itself. nicknames: (given_name, nickname), a fixed
    table, to which quoted nicknames in the names are added.
    """
    return _linked_parts(rows, key, texts, nicknames, model)[0]


def link_kinds(rows: DataFrame, key: str, texts: list[str], nicknames: DataFrame, model: Model) -> DataFrame:
    """(kind, n_links): how many links the metric gives, and how many each relation that is no distance."""
    parts = _linked_parts(rows, key, texts, nicknames, model)[1]
    counted = [links.agg(F.count("*").alias("n_links")).select(F.lit(kind).alias("kind"), "n_links") for kind, links in parts.items()]
    return reduce(DataFrame.unionByName, counted)


def entity_pairs(linked: DataFrame, cell: int = 20_000) -> DataFrame:
    """(key_a, key_b) of different keys of one entity, key_a < key_b; entities of many keys are split into blocks."""
    sizes = linked.groupBy("entity").agg(F.count("*").alias("n")).filter("n > 1").select("entity", F.ceil(F.col("n") / cell).cast("int").alias("salts"), F.col("n").alias("n_rows"))
    mine = salted_join(linked.select("key", "entity"), sizes, "entity", "key", "inner", cell)
    left = mine.select("entity", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"), F.col("key").alias("key_a"))
    right = mine.select("entity", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("key").alias("key_b"))
    return left.join(right, ["entity", "salt"]).filter("key_a < key_b").select("key_a", "key_b")
