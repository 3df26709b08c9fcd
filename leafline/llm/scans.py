"""Repair of text from scanned pages.

Pages of a document are taken together in reading order (page, uid), in groups of CROWDED with half a group of each
neighbour as context, so a document of any length makes bounded groups, however many blocks have one page number.
Every page is seen with CROWDED / 2 before it and after it at least. In a group:

* Page numbers are edge lines with nothing but a number in some style, if it is the page's own or
  keeps the same distance to it on three pages or more.
* Running lines are edge lines that come again, up to recognition errors and page numbers, at the edge of another
  page; a line that ends like a sentence, or has two running lines outside of it, must come again on OFTEN of all pages, and on three at least.
* Both are taken away from the outermost lines inwards until no edge changes, however many lines a header has.
* Words broken at the end of a line or page are asked of the corpus vocabulary, joined and hyphenated; the form the
  corpus has more often wins. A break of which it has neither is joined unless what follows is a word by itself
  (then the hyphen is a suspended one).
* Words the corpus hardly has are asked with every usual confusion of shapes undone; the most frequent
  word found, if it is MUCH more frequent, is the right one. A word of TWO_FROM letters or more that finds none and that the
  clean texts lack is asked with two confusions: words with one undone meet good words with one made, so pairs of confusions are never listed.

The vocabulary counts all words of all texts, clean and scanned; it stays distributed and is joined by merging, not shipped.
Rows delivered twice count once. Null and blank pages have no noise. A page without a document or a page number
has no neighbours, so it is taken by itself.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafline.llm.lookalike import table_form
from leafline.session import scratch

CROWDED = 1600
KNOWN, MUCH = 3, 10
ALIKE = 0.9
OFTEN = 0.4
TWO_FROM = 6
COMMON = 1000

# Signs that break a word at a line's end; the last two do nothing else.
BREAKS = "-‐‑¬­"
SURE_BREAKS = "¬­"

# Signs that a sentence, or a part of one that goes on, ends with.
SENTENCE_ENDS = ".!?。！？,;，；、" + BREAKS

# What a scan makes of letters, the right form first.
CONFUSIONS = [
    ("a", "u"), ("a", "o"), ("b", "6"), ("b", "h"), ("c", "("), ("c", "e"), ("d", "cl"), ("e", "c"), ("f", "t"), ("g", "9"), ("g", "q"), ("h", "b"), ("h", "li"),
    ("i", "1"), ("i", "l"), ("i", "|"), ("in", "m"), ("l", "1"), ("l", "i"), ("l", "|"), ("li", "h"), ("m", "rn"), ("m", "in"), ("n", "ri"), ("n", "u"), ("nn", "m"), ("o", "0"), ("o", "c"),
    ("ri", "n"), ("rn", "m"), ("s", "5"), ("t", "f"), ("t", "l"), ("u", "ii"), ("u", "n"), ("w", "vv"), ("z", "2"), ("b", "8"), ("q", "9"), ("v", "y"),
]

WORD = re.compile(r"[^\W_](?:[\w|(]*[\w|])?(?:-[\w|(]*[\w|])*|[|(][\w|(]*[\w|](?:-[\w|(]*[\w|])*")
LETTERS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
RUN = re.compile(r"[^\s'’々-ヿ㐀-鿿豈-﫿]+")
DIGIT = re.compile(r"\d")
HAN = re.compile("[々-ヿ㐀-鿿豈-﫿]")
ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)
NUMBER = re.compile(r"[\W_]*(?:(?:page|seite|pagina|página|pág|pag|p|s|第)[\s.]*)?([0-9a-z|]+)\s*(?:頁|页|ページ)?(?:\s*(?:/|of|von|de|di|sur|共)\s*[0-9a-z|]+\s*(?:頁|页|ページ)?)?[\W_]*", re.I)
DIGITS = str.maketrans("lI|oOsSbgzZ", "11100556922")


def words(text: str) -> list[str]:
    """Lower-case words of clean text: letters with inner hyphens; what holds a digit is none, nor are scripts without word spaces."""
    out = []
    for run in RUN.findall(table_form(text).lower()):
        if run.isalpha():
            out.append(run)
        elif DIGIT.search(run):
            out.extend(w for w in re.findall(r"\w+(?:-\w+)*", run.replace("_", " ")) if LETTERS.fullmatch(w))
        else:
            out.extend(LETTERS.findall(run))
    return out


def roman(text: str) -> int:
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    n = [value[c] for c in text.lower()]
    return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0]))


@lru_cache(10_000)
def numbers(line: str) -> tuple[int, ...]:
    """The page numbers a line may be, by digits or Roman; none if it holds anything else."""
    m = NUMBER.fullmatch(line.strip())
    if not m:
        return ()
    out = []
    if (d := m[1].translate(DIGITS)).isdecimal() and len(d) < 19:  # page is an integer, which has no more
        out.append(int(d))
    if ROMAN.fullmatch(m[1]):
        out.append(roman(m[1]))
    return tuple(out)


def title_key(line: str) -> str:
    """A line without page numbers at its ends, in lower case."""
    line = re.sub(r"^[\W_]*(?:\d+|[ivxlc]+(?=\s{2}|\s*[|·–—-]))[\W_]+|[\W_]+(?:\d+|[|·]\s*[ivxlc]+)[\W_]*$", "", line.strip(), flags=re.I)
    return re.sub(r"\s+", " ", line).strip().casefold()


@lru_cache(50_000)
def readings(word: str) -> frozenset[str]:
    return frozenset({word, *spellings(word)})


letters = lru_cache(50_000)(frozenset)


@lru_cache(50_000)
def same_word(a: str, b: str) -> bool:
    """Whether two words may be readings of the same one."""
    if not readings(a).isdisjoint(readings(b)):
        return True
    # A letter that only one of them has is never matched, so most words needn't be compared.
    if min(len(a), len(b)) <= 5 or 1 - len(letters(a) ^ letters(b)) / (len(a) + len(b)) < ALIKE:
        return False
    return difflib.SequenceMatcher(None, a, b, False).ratio() >= ALIKE


def same_line(a: str, b: str) -> bool:
    """Whether two lines are equal word by word, up to recognition errors."""
    x, y = a.split(" "), b.split(" ")
    return len(x) == len(y) and all(v == w or same_word(v, w) for v, w in zip(x, y))


class Page:
    def __init__(self, uid: object, number: int | None, text: str, own: bool = True):
        self.uid, self.number, self.own = uid, number, own
        self.lines = re.split(r"\r\n|\r|\n", text)
        self.drop: dict[int, str] = {}

    def edges(self) -> list[int]:
        """Indexes of the outermost lines at either end that are still there."""
        held = self.body()
        return sorted({*held[:1], *held[-1:]})

    def body(self) -> list[int]:
        return [i for i, s in enumerate(self.lines) if s.strip() and i not in self.drop]


def mark_numbers(pages: list[Page]) -> bool:
    """Marks page numbers at the edges as they are now; whether there were any."""
    found = [(p, i, n - p.number) for p in pages if p.number is not None for i in p.edges() for n in numbers(p.lines[i])]
    steady = Counter(d for _, d in {(id(p), d) for p, _, d in found})
    marked = False
    for p, i, d in found:
        if d == 0 or steady[d] >= 3:
            p.drop[i] = "page_number"
            marked = True
    return marked


def mark_titles(pages: list[Page], first: bool) -> bool:
    """Marks running lines at the edges as they are now; whether there were any. Only in the ``first`` rounds two pages are enough."""
    groups: list[tuple[str, list[tuple[Page, int]]]] = []
    of_size: dict[int, dict[str, list[int]]] = {}
    exact: dict[str, int] = {}
    for p in pages:
        for i in p.edges():
            key = title_key(p.lines[i])
            if len(key) < 3 or not any(c.isalpha() for c in key):
                continue
            if (g := exact.get(key)) is None:
                begin = key.partition(" ")[0]
                alike = of_size.setdefault(key.count(" "), {})
                near = sorted(g for w, held in alike.items() if w == begin or same_word(w, begin) for g in held)
                if (g := next((g for g in near if same_line(groups[g][0], key)), None)) is None:
                    g = len(groups)
                    alike.setdefault(begin, []).append(g)
                    groups.append((key, []))
                exact[key] = g
            groups[g][1].append((p, i))
    marked = False
    for _, members in groups:
        on = len({id(p) for p, _ in members})
        if not (on >= 3 and on >= OFTEN * len(pages)):
            members = [(p, i) for p, i in members if p.lines[i].strip()[-1] not in SENTENCE_ENDS]
            if not first or len({id(p) for p, _ in members}) < 2:
                continue
        for p, i in members:
            p.drop[i] = "running_line"
            marked = True
    return marked


def analyse(pages: list[Page]) -> None:
    rounds = 0
    while mark_numbers(pages) | mark_titles(pages, rounds < 2):
        rounds += 1


def first_word(line: str) -> str:
    m = re.match(r"\s*([^\W_][\w|(]*(?:-[\w|(]+)*)", line)
    return m[1] if m else ""


def breaks(pages: list[Page]) -> list[tuple[Page, int, Page, int, str, str, bool]]:
    """(page, line, next page, next line, left, right, sure) of words that a line or page end may break."""
    flat = [(k, p, i) for k, p in enumerate(pages) for i in p.body()]
    out = []
    for (k, p, i), (l, q, j) in zip(flat, flat[1:]):
        line = p.lines[i].rstrip()
        if line[-1] in BREAKS and l - k <= 1:
            left = re.search(r"([^\W_][\w|(]*(?:-[\w|(]+)*)[" + BREAKS + r"]$", line)
            right = first_word(q.lines[j])
            if left and right and right[0].isalnum() and not HAN.match(right) and not HAN.search(left[1]):
                out.append((p, i, q, j, left[1], right, line[-1] in SURE_BREAKS))
    return out


def page_words(pages: list[Page], broken: list) -> dict[int, list[str]]:
    """Lower-case words of each page's body, those of breaks left out; an opening bracket that never closes stays with its word."""
    out: dict[int, list[str]] = {}
    ends = {(id(p), i): left for p, i, _, _, left, _, _ in broken}
    starts = {(id(q), j): right for _, _, q, j, _, right, _ in broken}
    for p in pages:
        body = []
        for i in p.body():
            line = p.lines[i]
            if right := starts.get((id(p), i)):
                line = line.lstrip()[len(right) :]
            if left := ends.get((id(p), i)):
                line = line.rstrip()[: -len(left) - 1]
            body.append(line)
        text = table_form("\n".join(body)).lower()
        for sign in "‐‑":
            text = text.replace(sign, "-")
        keep = []
        opened = [m.start() for m in re.finditer(r"(?<![\w|])\(", text)]
        alone = {a for a, b in zip(opened, [*opened[1:], len(text)]) if ")" not in text[a:b]}
        for m in RUN.finditer(text):
            chunk = m[0]
            if chunk[0] == "(" and m.start() not in alone:
                chunk = chunk[1:]
            keep += [chunk] if chunk.isalpha() else [w for w in WORD.findall(chunk) if any(c.isalpha() for c in w)]
        out[id(p)] = keep
    return out


@lru_cache(20_000)
def misreadings(word: str) -> tuple[str, ...]:
    """The word with one confusion made at any one place."""
    out = set()
    for right, wrong in CONFUSIONS:
        at = word.find(right)
        while at >= 0:
            out.add(word[:at] + wrong + word[at + len(right) :])
            at = word.find(right, at + 1)
    out.discard(word)
    return tuple(out)


def undone(token: str) -> set[str]:
    """The token with one confusion undone at any one place."""
    out = set()
    for right, wrong in CONFUSIONS:
        at = token.find(wrong)
        while at >= 0:
            out.add(token[:at] + right + token[at + len(wrong) :])
            at = token.find(wrong, at + 1)
    out.discard(token)
    return out


def spellings(token: str) -> set[str]:
    """Words, as to their letters, that the token with one confusion undone may be."""
    return {w for w in undone(token) if LETTERS.fullmatch(w)}


def grouped(pages: DataFrame) -> DataFrame:
    """(doc, chunk, part, own, uid, page, text), each page in its own chunk and in those it is context of.

    A chunk is CROWDED pages of a document in a row; ``part`` is 0 but for pages that stand alone. Pages are numbered
    without their texts, so that those of a long document never meet in one task.
    """
    order = F.row_number().over(Window.partitionBy("doc").orderBy("page", "uid")) - 1
    places = pages.select("doc", "page", "uid").filter("doc is not null and page is not null").distinct().withColumn("place", order)
    alone = F.col("place").isNull()
    chunk = lambda ahead: F.floor((F.col("place") + ahead) / CROWDED)
    near = F.array_distinct(F.filter(F.array(chunk(0), chunk(-(CROWDED // 2)), chunk(CROWDED // 2)), lambda c: c >= 0))
    near = F.when(alone, F.array(F.lit(0).cast("long"))).otherwise(near)
    out = pages.select("doc", "uid", "page", "text").join(places.hint("merge"), ["doc", "page", "uid"], "left").withColumn("chunk", F.explode(near))
    return out.select("doc", "chunk", F.when(alone, F.xxhash64("uid")).otherwise(0).alias("part"), (alone | (F.col("chunk") == chunk(0))).alias("own"), "uid", "page", "text")


def _read(parts: Iterator[pa.RecordBatch]) -> list[Page]:
    """The pages of a group in order; none if all are context."""
    rows = {r["uid"]: r for part in parts for r in part.to_pylist() if r["text"] and r["text"].strip()}
    pages = [Page(r["uid"], r["page"], r["text"], r["own"]) for r in sorted(rows.values(), key=lambda r: (r["page"] or 0, r["uid"]))]
    return pages if any(p.own for p in pages) else []


def parse(pages: DataFrame) -> DataFrame:
    """(uid, kind, raw, a, b) of all pages: finished lines, breaks to be asked (kind split), and all words in one row a page."""

    def run(_: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _read(parts)
        analyse(found)
        broken = breaks(found)
        per_page = page_words(found, broken)
        rows = []
        for p in found:
            if p.own:
                rows += [(p.uid, kind, p.lines[i].strip(), "", "") for i, kind in p.drop.items()]
                rows.append((p.uid, "words", " ".join(sorted(set(per_page[id(p)]))), "", ""))
        for p, _, _, _, left, right, sure in broken:
            if p.own:
                rows.append((p.uid, "sure" if sure else "split", f"{left}\n{right}", table_form(left).lower(), table_form(right).lower()))
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if n == 0 else pa.string()) for n, c in enumerate(columns)], ["uid", "kind", "raw", "a", "b"])

    run.__annotations__ = {"_": tuple[pa.Scalar, ...], "parts": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return grouped(pages).groupBy("doc", "chunk", "part").applyInArrow(run, "uid long, kind string, raw string, a string, b string")


def count_words(texts: DataFrame) -> DataFrame:
    """(w, n): words of a column ``text``, counted once in each batch before anything is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(words(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["w", "n"])

    return texts.select("text").mapInArrow(run, "w string, n long")


def _expand(df: DataFrame, name: str, made: Callable[[str], Iterable[str]]) -> DataFrame:
    """``df``, whose first column is a word, with each of the words made of it as ``name``."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(i, v) for i, w in enumerate(batch.column(0).to_pylist()) for v in made(w)]
            take = pa.array([i for i, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array([v for _, v in pairs], pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def corrections(vocabulary: DataFrame, path: str) -> DataFrame:
    """(w, fixed): words of scans that are misread, and the right ones; ``path`` is for a table on the way."""
    spark = vocabulary.sparkSession
    much = (F.col("good") >= MUCH * F.col("total")) & (F.col("good") >= KNOWN) & ((F.col("clean") < KNOWN) | (F.col("clean") * 200 < F.col("good_clean")))
    best = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("good"), "fixed"))

    def chosen(tried: DataFrame) -> DataFrame:
        return tried.filter(much).withColumn("r", best).filter("r = 1").select("w", "fixed")

    odd = vocabulary.filter("scan > 0").select("w", "clean", "total").filter(F.length("w") > 1)
    good = vocabulary.select(F.col("w").alias("fixed"), F.col("clean").alias("good_clean"), F.col("total").alias("good")).filter(F.col("good") >= KNOWN)
    chosen(_expand(odd, "fixed", spellings).join(good.hint("merge"), "fixed")).write.parquet(path)
    once = spark.read.parquet(path)
    # Two confusions: what one undone makes of the word is what one made makes of a good word.
    left = odd.filter((F.col("clean") == 0) & (F.length("w") >= TWO_FROM)).join(once.select("w"), "w", "left_anti")
    halfway = _expand(good.filter(F.col("good_clean") >= KNOWN), "half", misreadings)
    twice = chosen(_expand(left, "half", undone).join(halfway.hint("merge"), "half").filter("w <> fixed"))
    return once.unionByName(twice)


def noise(pages: DataFrame, clean: DataFrame) -> DataFrame:
    """(uid, kind, raw, fixed) of all noise of ``pages`` (doc, page, uid, text), by the vocabulary of ``pages`` and ``clean`` (text).

    ``raw`` is what stands on the page: the line, the word, or the two parts with a line break.
    """
    spark = pages.sparkSession
    path = scratch(spark, "scans")
    parse(pages).write.parquet(f"{path}/parsed")
    parsed = spark.read.parquet(f"{path}/parsed")
    each = parsed.filter("kind = 'words'").select("uid", F.explode(F.split("raw", " ")).alias("w")).filter("w <> ''")
    counts = count_words(clean).select("w", F.col("n").alias("clean"), F.lit(0).cast("long").alias("scan")).unionByName(each.select("w", F.lit(0).cast("long").alias("clean"), F.lit(1).cast("long").alias("scan")))
    counts.groupBy("w").agg(F.sum("clean").alias("clean"), F.sum("scan").alias("scan")).withColumn("total", F.col("clean") + F.col("scan")).write.parquet(f"{path}/words")
    vocabulary = spark.read.parquet(f"{path}/words")

    lines = parsed.filter("kind in ('running_line', 'page_number')").select("uid", "kind", "raw", F.col("raw").alias("fixed"))
    wrong = corrections(vocabulary, f"{path}/once")
    # The commonest words, at most COMMON by their share, make most rows; those that aren't misread needn't travel.
    everything = vocabulary.agg(F.sum("total")).first()[0] or 0
    common = vocabulary.filter(F.col("total") * COMMON > everything).select("w").join(wrong.select("w"), "w", "left_anti").collect()
    rare = each.filter(~F.col("w").isin([r["w"] for r in common])) if common else each
    misread = rare.join(wrong.hint("merge"), "w").select("uid", F.lit("misread").alias("kind"), F.col("w").alias("raw"), "fixed")

    def known(name: str) -> DataFrame:
        return vocabulary.select(F.col("w").alias(name), F.col("total").alias(f"n_{name}"), F.col("clean").alias(f"c_{name}")).hint("merge")

    n = lambda name: F.coalesce(F.col(f"n_{name}"), F.lit(0))
    asked = parsed.filter("kind in ('split', 'sure')").select("uid", "raw", (F.col("kind") == "sure").alias("sure"), F.concat("a", "b").alias("j"), F.concat_ws("-", "a", "b").alias("h"), "b")
    fixed: Column = F.when((n("h") > 0) & (n("h") >= n("j")), F.col("h")).when((n("j") > 0) | F.col("sure") | (F.coalesce("c_b", F.lit(0)) < KNOWN), F.col("j"))
    split = asked.join(known("j"), "j", "left").join(known("h"), "h", "left").join(known("b"), "b", "left").select("uid", F.lit("split_word").alias("kind"), "raw", fixed.alias("fixed")).filter("fixed is not null and not fixed rlike '[0-9|(]'")
    return lines.unionByName(misread).unionByName(split).distinct()


def _cased(raw: str, fixed: str) -> str:
    return fixed[:1].upper() + fixed[1:] if raw[:1].isupper() else fixed


def rebuild(pages: list[Page], fixes: dict[object, list[tuple[str, str, str]]]) -> list[tuple[object, int, str]]:
    """(uid, page, paragraph) in reading order; a paragraph belongs to the page where it begins."""
    analyse(pages)
    joined = {(p.uid, raw): fixed for p in pages for kind, raw, fixed in fixes.get(p.uid, []) if kind == "split_word"}
    begin: dict[tuple[int, int], int] = {}
    tail: dict[tuple[int, int], tuple[int, str]] = {}
    for p, i, q, j, left, right, _ in breaks(pages):
        if (fixed := joined.get((p.uid, f"{left}\n{right}"))) is not None:
            tail[id(p), i] = (len(left) + 1, _cased(left, fixed))
            begin[id(q), j] = len(right)
    out: list[tuple[object, int, list[str]]] = []
    blank = True
    for p in pages:
        right = {raw: fixed for kind, raw, fixed in fixes.get(p.uid, []) if kind == "misread"}
        body = set(p.body())
        for i, line in enumerate(p.lines):
            if i in p.drop:
                continue
            if i not in body:
                blank = True
                continue
            text = line.rstrip()
            indented = len(text) - len(text.lstrip()) > 1
            text = text.lstrip()
            cut, whole = tail.get((id(p), i), (0, ""))
            text = text[begin.get((id(p), i), 0) : len(text) - cut]
            if right:
                text = re.sub(r"[\w|(]+(?:-[\w|(]+)*", lambda m: _cased(m[0], right.get(m[0].lower(), m[0])), text)
            text = text + whole
            if blank or indented or not out:
                out.append((p.uid, p.number, [text.strip()]))
            elif (id(p), i) in begin:
                out[-1][2][-1] += text
            elif out[-1][2][-1][-1:] and HAN.search(out[-1][2][-1][-1:] + text[:1]):
                out[-1][2][-1] += text
            else:
                out[-1][2].append(text)
            blank = False
    return [(uid, number, " ".join(s for s in parts if s)) for uid, number, parts in out]


def paragraphs(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(uid, page, paragraph_no, paragraph): the repaired pages as continuous paragraphs; ``found`` is what ``noise`` gave."""
    fixes = found.filter("kind in ('split_word', 'misread')").groupBy("uid").agg(F.to_json(F.collect_list(F.struct("kind", "raw", "fixed"))).alias("fixes"))

    def run(_: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        held = list(parts)
        known = {r["uid"]: [(f["kind"], f["raw"], f["fixed"]) for f in json.loads(r["fixes"])] for part in held for r in part.to_pylist() if r["fixes"]}
        pages = _read(iter(held))
        own = {p.uid for p in pages if p.own}
        rows, number = [], Counter()
        for uid, page, text in rebuild(pages, known):
            if uid in own:
                rows.append((uid, page, number[uid], text))
                number[uid] += 1
        columns = list(zip(*rows)) if rows else [[]] * 4
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["uid", "page", "paragraph_no", "paragraph"])

    run.__annotations__ = {"_": tuple[pa.Scalar, ...], "parts": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return grouped(pages).join(fixes, "uid", "left").groupBy("doc", "chunk", "part").applyInArrow(run, "uid long, page int, paragraph_no int, paragraph string")
