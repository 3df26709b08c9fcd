"""One consistent form for texts that look the same.

Alike count: width forms, ligatures, radical and positional forms of a character; composed and decomposed accents;
all single space characters; letters of other scripts with the same shape. Characters of no width count as
absent. Case, accents, digits against letters, raised or circled signs, tabs, line breaks and the number of spaces
stay as they are. ``table_form`` maps a text by table alone.

``Vocabulary`` is a trie of good spellings. A weighted edit automaton walks it with a token as it is stored:
look-alikes and ignorables cost nothing, any other edit costs 1. Look-alikes are what the table says and the further READINGS
of a letter whose shape is that of several letters, which only a word can tell apart. With the cost limit of 0 a token becomes
the good spelling that looks exactly like it, so a genuine word of another script keeps its letters and 'Straβe' is
'Straße'; a token without a good spelling gets its table form.

The consistent form of a text so follows from its looks and the vocabulary alone, and texts are paired by it.

A null text stays null, the empty text stays empty. Rows are independent.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafline.session import scratch

# Letters of other scripts and the Latin letters of the same shape.
SAME_SHAPE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ν": "v", "ο": "o", "ρ": "p", "Ϲ": "C", "ϲ": "c", "Ϳ": "J", "ϳ": "j",
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ѵ": "v", "Ѵ": "V", "Ү": "Y", "ү": "y",
    "һ": "h", "Ӏ": "I", "ӏ": "l", "ԁ": "d", "Ԛ": "Q", "ԛ": "q", "Ԝ": "W", "ԝ": "w",
    "Լ": "L", "Օ": "O", "Տ": "S", "Ս": "U", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ɑ": "a", "ɡ": "g",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X",
}

# Letters whose shape is also that of another letter than the table's; only a known word tells which is meant.
READINGS = {"Ӏ": "l", "ӏ": "I", "ꓲ": "l", "Ⲓ": "l", "β": "ß", "ϐ": "ß", "ꞵ": "ß", "ǀ": "lI", "Ɩ": "lI"}

# Radical forms that have no decomposition of their own.
RADICALS = {
    "⺁": "厂", "⺂": "乛", "⺃": "乚", "⺄": "乙", "⺅": "亻", "⺆": "冂", "⺉": "刂", "⺊": "卜", "⺎": "兀", "⺏": "尣", "⺐": "尢", "⺒": "巳", "⺓": "幺", "⺔": "彑", "⺖": "忄", "⺗": "㣺", "⺘": "扌", "⺙": "攵", "⺛": "旡", "⺞": "歺",
    "⺠": "民", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺤": "爫", "⺥": "爫", "⺦": "丬", "⺨": "犭", "⺪": "疋", "⺬": "示", "⺭": "礻", "⺮": "竹", "⺯": "糹", "⺰": "纟", "⺱": "罓", "⺲": "罒", "⺶": "羊", "⺷": "羊", "⺸": "羋", "⺹": "耂", "⺺": "肀",
    "⺽": "臼", "⺾": "艹", "⺿": "艹", "⻀": "艹", "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻈": "讠", "⻉": "贝", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻖": "阝",
    "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠", "⻠": "饣", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "斉", "⻬": "齐", "⻭": "歯",
    "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龜", "⻲": "亀",
}

#: Kinds of compatibility decompositions that keep the shape; 'compat' only for ligatures and radicals.
SAME_LOOK = {"<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>"}


@lru_cache(1)
def char_table() -> dict[int, str]:
    """What each code point of a canonically decomposed text becomes, where it changes."""
    out: dict[int, str] = {}
    for c in range(0x110000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            if c != 0x20:
                out[c] = " "
            continue
        if kind == "Cf" or c in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or 0x180B <= c <= 0x180F:
            out[c] = ""
            continue
        tag, _, parts = unicodedata.decomposition(ch).partition(" ")
        if tag in SAME_LOOK or tag == "<compat>" and re.search("LIGATURE|RADICAL", unicodedata.name(ch, "")):
            out[c] = unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in parts.split()))
    out[0x2011] = "‐"
    out |= {ord(k): v for k, v in (SAME_SHAPE | RADICALS).items()}
    for c, v in list(out.items()):  # a part may itself be in the table
        out[c] = v.translate(out)
    return out


def char_class(points: Iterable[int]) -> str:
    """The inside of a character class of the code points."""
    ranges: list[list[int]] = []
    for c in sorted(points):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)


@lru_cache(2)
def unsure(letters: bool = False) -> re.Pattern[str]:
    """Finds code points that are in the table, or that a canonical form may change; with ``letters`` no spaces, digits and signs of those."""
    points = {*char_table(), *map(ord, READINGS), *(c for c in range(0x300, 0x110000) if unicodedata.combining(chr(c)) or not 0xAC00 <= c <= 0xD7A3 and unicodedata.normalize("NFC", chr(c)) != chr(c))}
    points |= {c for c in range(0x1D00) if any(ord(x) in char_table() for x in unicodedata.normalize("NFD", chr(c)))}
    return re.compile("[" + char_class(c for c in points if not letters or unicodedata.category(chr(c))[0] in "LMC") + "]")


def table_form(text: str) -> str:
    if text.isascii() or not unsure().search(text):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(char_table()))


@lru_cache(100_000)
def readings(c: str) -> tuple[str, ...]:
    """What a decomposed character may stand for at no cost, each a string of characters, the table's reading first."""
    first = char_table().get(ord(c), c)
    return first, *(r for r in READINGS.get(c, "") if r != first)


@lru_cache(1)
def words_or_not() -> re.Pattern[str]:
    """Parts a decomposed text: runs of what may belong to a word (letters, marks on them, what has no width), and runs of the rest."""
    also = {c for c in range(0x300, 0x110000) if unicodedata.combining(chr(c))}
    also |= {c for c, v in char_table().items() if not chr(c).isalpha() and all(r.isalpha() or unicodedata.combining(r) for r in v)}
    inside = char_class(also)
    return re.compile(rf"((?:[^\W\d_]|[{inside}])+)|(?:(?![{inside}])[\W\d_])+")


class Vocabulary:
    """A trie of spellings; of spellings that look the same the first stays."""

    END = ""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        self.cache: dict[str, str] = {}
        self.replaced = False  # whether a text of plain letters may have to change
        for word in words:
            node = self.root
            for c in unicodedata.normalize("NFD", table_form(word)):
                node = node.setdefault(c, {})
            self.replaced |= node.setdefault(self.END, word) != table_form(word)

    def spelling(self, token: str, limit: int = 0) -> str | None:
        """The good spelling at the least cost, at most ``limit``; of equal costs that of the fewest further READINGS, then the alphabetically first."""

        def put(to: dict[int, tuple[dict, tuple[int, int]]], node: dict, cost: tuple[int, int]) -> None:
            if cost[0] <= limit and cost < to.get(id(node), (node, (limit + 1, 0)))[1]:
                to[id(node)] = (node, cost)
                if cost[0] < limit:  # a letter of the spelling that the token lacks
                    for c, child in node.items():
                        if c:
                            put(to, child, (cost[0] + 1, cost[1]))

        states: dict[int, tuple[dict, tuple[int, int]]] = {}
        put(states, self.root, (0, 0))
        for c in unicodedata.normalize("NFD", token):
            following: dict[int, tuple[dict, tuple[int, int]]] = {}
            for k, reading in enumerate(readings(c)):
                at = states
                for unit in reading:
                    onward: dict[int, tuple[dict, tuple[int, int]]] = {}
                    for node, (cost, odd) in at.values():
                        if unit in node:
                            put(onward, node[unit], (cost, odd + (k > 0)))
                        if cost < limit:
                            put(onward, node, (cost + 1, odd))
                            for other, child in node.items():
                                if other:
                                    put(onward, child, (cost + 1, odd))
                    at = onward
                for node, cost in at.values():
                    put(following, node, cost)
            states = following
            if not states:
                return None
        ends = [(cost, node[self.END]) for node, cost in states.values() if self.END in node]
        return min(ends)[1] if ends else None

    def canonical(self, text: str) -> str:
        """The text with every token in its good spelling, else in its table form."""
        if not self.replaced and (text.isascii() or not unsure().search(text)):
            return text
        return re.sub(r"\S+|\s+", lambda m: self._token(m[0]), text)

    def _token(self, token: str) -> str:
        if (known := self.cache.get(token)) is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            if not self.replaced and not unsure().search(token):
                known = token
            else:  # words between other signs are looked up one by one, as they are stored
                known = unicodedata.normalize("NFC", words_or_not().sub(self._part, unicodedata.normalize("NFD", token)))
            self.cache[token] = known
        return known

    def _part(self, m: re.Match[str]) -> str:
        part = m[0]
        if m[1] is None:
            return part.translate(char_table())
        if not self.replaced and part.isascii():
            return part
        good = self.spelling(part)
        return part.translate(char_table()) if good is None else good


def canonical_texts(df: DataFrame, text: str, keep: list[str], vocabulary: Iterable[str] = ()) -> DataFrame:
    """``keep``, the canonical ``text``, and ``key`` and ``raw``: 128-bit hashes of it and of what was stored.

    Map-only. Equal keys mean equal looks. The vocabulary is shipped whole and must be a bounded list of good spellings.
    """
    words = list(vocabulary)
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField(text, T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("raw", T.BinaryType())])

    def digest(t: str | None) -> bytes | None:
        return t if t is None else xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = Vocabulary(words)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            done = [t if t is None else good.canonical(t) for t in texts]
            raws = [digest(t) for t in texts]
            keys = [raw if d is t else digest(d) for d, t, raw in zip(done, texts, raws)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(done, pa.string()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], [*keep, text, "key", "raw"])

    return df.select(*keep, text).mapInArrow(run, schema)


def alike_pairs(df: DataFrame, item: str, text: str, vocabulary: Iterable[str] = ()) -> DataFrame:
    """(id_a, id_b), a < b, of items that look the same but aren't stored the same; null texts and ids take no part.

    One aggregation over all items finds the looks that have several spellings. Only their items go on: each spelling's list of
    the other spellings of its look meets the items on both sides, so items of one spelling never meet each other,
    however many there are; work follows the result.
    """
    spark = df.sparkSession
    path = scratch(spark, "alike")
    valid = df.filter(F.col(item).isNotNull() & F.col(text).isNotNull())
    canonical_texts(valid, text, [item], vocabulary).select(F.col(item).alias("id"), "key", "raw").write.parquet(f"{path}/all")
    every = spark.read.parquet(f"{path}/all")
    mixed = every.groupBy("key").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter("lo <> hi").select("key")
    every.join(mixed, "key", "left_semi").write.parquet(f"{path}/mixed")
    rows = spark.read.parquet(f"{path}/mixed").distinct()
    spellings = rows.select("key", "raw").distinct()
    a, b = spellings.withColumnRenamed("raw", "raw_a"), spellings.withColumnRenamed("raw", "raw_b")
    pairs = a.join(b, "key").filter("raw_a < raw_b")
    first = rows.select("key", F.col("raw").alias("raw_a"), F.col("id").alias("x"))
    second = rows.select("key", F.col("raw").alias("raw_b"), F.col("id").alias("y"))
    both = pairs.join(first, ["key", "raw_a"]).join(second, ["key", "raw_b"]).filter("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
