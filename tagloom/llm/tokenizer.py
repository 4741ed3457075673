"""Byte-level BPE of a public tokenizer as Spark expressions.

A text is cut into words by the tokenizer's pattern. A word becomes its bytes, one character (U+0000 to U+00FF) each, and ranked
merges are folded over their ids with higher-order functions: each step joins the leftmost pair of lowest rank, whose rank is the new id, and looks
up only the two pairs that this makes. Ranks are a literal perfect-hash map, so a look-up reads two array slots.

The most frequent distinct words of the whole corpus, up to ``KNOWN_WORDS``, are folded once and become a second literal of the same kind; any other word is
folded where it stands. That bound only decides where a word is folded, the ids are the same. So the texts are never shuffled, only
the distinct words are, counted on the map side first.

Long runs of letters without spaces are cut once more, between characters of three bytes and more that no vocabulary entry spans, which
cannot change the merges and keeps the fold short.

Defined results: null and empty texts have an empty list; strings of special tokens are ordinary text; decoding a list of ids gives the text back.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import Scratch

#: Where the vocabulary files are, unless the caller names another folder.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct words whose ids are kept as a literal; bounds what is collected and sent to the tasks.
KNOWN_WORDS = 40_000
#: Rank of a pair that is no vocabulary entry.
NONE = 2**31 - 1
# Unicode's white space, and the word pattern of the vocabulary.
SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


@lru_cache(maxsize=4)
def load_ranks(file: str) -> dict[bytes, int]:
    with Path(file).open("rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def load_merges(file: str) -> dict[tuple[int, int], int]:
    """The two entries that each longer entry is merged from, found by running the merges of lower rank over its bytes."""
    ranks = load_ranks(file)
    merges: dict[tuple[int, int], int] = {}
    for piece, rank in ranks.items():
        if len(piece) == 1:
            continue
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], NONE))
            if ranks.get(parts[at] + parts[at + 1], NONE) >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges[ranks[parts[0]], ranks[parts[1]]] = rank
    return merges


class Known:
    """A literal map from word to ids, hashed into small maps by crc32, as Spark scans a map's keys one by one."""

    def __init__(self, words: dict[str, list[int]]):
        self.size = 1 << max(0, (len(words) - 1).bit_length() - 1)
        maps: list[dict] = [{} for _ in range(self.size)]
        for key, value in words.items():
            maps[zlib.crc32(key.encode()) % self.size][key] = value
        self.literal = F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,array<int>>>")

    def __call__(self, key: Column) -> Column:
        bucket = F.element_at(self.literal, (F.crc32(key.cast("binary")) % self.size + 1).cast("int"))
        return F.try_element_at(bucket, key)


class Merges:
    """A literal map from a pair of ids to the id that they merge into, which is also its rank; ``FREE`` or more for other pairs.

    A pair is written (first + 1) << 32 | second << 16 and its entry is pair | id. Every entry has a slot of its own, found by a
    displacement (hash and displace), so a look-up is two array reads; entry XOR pair is the id for the pair itself and at least FREE for any other.
    """

    FREE = 1 << 16
    BUCKETS, SLOTS = 20_011, 75_011  # primes

    def __init__(self, merges: dict[tuple[int, int], int]):
        groups: dict[int, list[tuple[int, int]]] = {}
        for (a, b), c in merges.items():
            pair = (a + 1) << 32 | b << 16
            groups.setdefault(pair % self.BUCKETS, []).append((pair, c))
        slots, shifts = [0] * self.SLOTS, [0] * self.BUCKETS
        for bucket, group in sorted(groups.items(), key=lambda g: -len(g[1])):
            for shift in range(self.SLOTS):
                at = [(pair + shift) % self.SLOTS for pair, _ in group]
                if len(set(at)) == len(at) and not any(slots[i] for i in at):
                    break
            else:
                raise ValueError("the pairs don't fit; raise SLOTS")
            shifts[bucket] = shift
            for i, (pair, c) in zip(at, group):
                slots[i] = pair | c
        listed = lambda values: F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), "array<bigint>")
        self.slots, self.shifts = listed(slots), listed(shifts)

    @staticmethod
    def pair(a: Column, b: Column) -> Column:
        return (a.cast("bigint") + 1) * (1 << 32) + b.cast("bigint") * (1 << 16)

    def __call__(self, pairs: Column) -> Column:
        return F.transform(pairs, lambda p: F.get(self.slots, ((p + F.get(self.shifts, (p % self.BUCKETS).cast("int"))) % self.SLOTS).cast("int")).bitwiseXOR(p))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


@lru_cache(maxsize=4)
def _fragment_pattern(file: str) -> str | None:
    """Over bytes as characters: runs up to a place between two characters of 3 bytes or more that no entry spans."""
    unsafe: dict[int, set[int]] = {}
    for piece in load_ranks(file):
        for i in range(1, len(piece)):
            if piece[i] >= 0xE0 and piece[i - 1] >= 0x80:
                unsafe.setdefault(piece[i], set()).add(piece[i - 1])
    one = lambda b: f"\\x{b:02x}"
    free = "".join(one(b) for b in range(0xE0, 0xF5) if b not in unsafe)
    safe = [f"[{free}]"] if free else []
    for lead, lasts in sorted(unsafe.items()):
        safe.append(f"{one(lead)}(?<![{''.join(one(b) for b in sorted(lasts))}]{one(lead)})")
    boundary = rf"(?<=[\xe0-\xf4][\x80-\xbf]{{2,3}})(?=[\xe0-\xf4])(?={'|'.join(safe)})"
    return rf"(?s)[\x00-\xff](?:(?!{boundary})[\x00-\xff])*"


class Tokenizer:
    """Column expressions that encode and decode with one vocabulary file."""

    def __init__(self, folder: str = FOLDER, name: str = VOCABULARY):
        self.file = str(Path(folder) / name)
        self.ranks = load_ranks(self.file)
        if max(self.ranks.values()) >= 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.merges = Merges(load_merges(self.file))
        self.byte_ids = F.from_json(F.lit(json.dumps([self.ranks[bytes([b])] for b in range(256)])), "array<int>")
        self.fragment = _fragment_pattern(self.file)

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def _fold(self, piece: Column) -> Column:
        """Ids of one run of bytes (as characters) by ranked merges."""

        def step(state: Column, _: Column) -> Column:
            p, r = state["p"], state["r"]

            def merge(at: Column, new: Column) -> Column:
                left = F.transform(F.slice(p, F.greatest(at - 1, F.lit(1)), F.when(at > 1, 1).otherwise(0)), lambda x: self.merges.pair(x, new))
                right = F.transform(F.slice(p, at + 2, 1), lambda x: self.merges.pair(new, x))
                return F.struct(
                    F.concat(F.slice(p, 1, at - 1), F.array(new), F.slice(p, at + 2, F.size(p))).alias("p"),
                    F.concat(F.slice(r, 1, F.greatest(at - 2, F.lit(0))), self.merges(F.concat(left, right)), F.slice(r, at + 2, F.size(p))).alias("r"),
                )

            # the lowest rank is the id that the pair merges into
            return _let(F.array_min(r), lambda low: F.when(low < self.merges.FREE, _let(F.array_position(r, low).cast("int"), lambda at: merge(at, low.cast("int")))).otherwise(state))

        def run(p: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: self.merges.pair(F.get(p, i - 1), F.get(p, i)))
            start = F.struct(p.alias("p"), self.merges(pairs).alias("r"))
            return F.aggregate(F.sequence(F.lit(2), F.size(p)), start, step, lambda s: s["p"])

        ids = F.transform(F.filter(F.split(piece, ""), lambda x: x != ""), lambda c: F.get(self.byte_ids, F.ascii(c)))
        return _let(ids, lambda p: F.when(F.size(p) > 1, run(p)).otherwise(p))

    def encode_word(self, word: Column) -> Column:
        """Ids of one word, folded."""
        data = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
        pieces = F.regexp_extract_all(data, F.lit(self.fragment), F.lit(0))
        return F.flatten(F.transform(pieces, self._fold))

    def known_words(self, docs: DataFrame, text: str, limit: int = KNOWN_WORDS) -> Known | None:
        """The literal of the most frequent distinct words, counted over all texts, each folded once.

        All words as frequent as the rarest listed one are in it, so no task has to sort or choose: a histogram of the counts, of bounded
        size, gives the least count that at most ``limit`` words reach.
        """
        each = docs.select(F.explode(self.words(F.col(text))).alias("word"))
        counted = Scratch(docs.sparkSession, "words").put(each.groupBy("word").agg(F.count("*").alias("n")))
        step = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log2(F.col("n") / 1024) * 16)).cast("int")
        found, least = 0, None
        for row in counted.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():  # at most about 1,900 rows
            found += row["words"]
            if found > limit:
                break
            least = row["n"]
        if least is None:
            return None
        spread = max(1, min(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "64"))))
        ids = counted.filter(F.col("n") >= least).select("word").repartition(spread).select("word", self.encode_word(F.col("word")).alias("ids")).collect()
        return Known({r["word"]: r["ids"] for r in ids}) if ids else None

    def encode(self, docs: DataFrame, text: str, out: str = "ids", limit: int = KNOWN_WORDS) -> DataFrame:
        """Adds the ids of ``text`` to every row."""
        known = self.known_words(docs, text, limit)
        one = self.encode_word if known is None else lambda w: F.coalesce(known(w), self.encode_word(w))
        ids = F.flatten(F.transform(self.words(F.col(text)), one))
        return docs.withColumn(out, F.coalesce(ids, F.expr("cast(array() as array<int>)")))

    def decode(self, ids: Column) -> Column:
        """The text of a list of ids: the binary pieces put together."""
        pieces = [""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            pieces[v] = k.decode("latin-1")
        table = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")
        return F.decode(F.encode(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), ""), "ISO-8859-1"), "UTF-8")
