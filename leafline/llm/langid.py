"""Language of texts, and of each stretch of mixed ones, by prediction by partial matching.

Each language has byte context trees of the orders 0 to ORDER from labelled samples, frozen after training.
A byte is coded in the longest known context; where the context lacks it, an escape (method C: distinct
successors over successors plus distinct) is coded and the next shorter context tried, down to uniform bytes.
The sum is the exact code length in bits. Contexts begin at the start of a word, or at the character
before in scripts without word spaces, so a word's code length depends on the word alone and is computed
once a worker (the cache is cleared beyond CACHE_ENTRIES words).

A text's sentences get the language path of least code length, with SWITCH bits for each change. A language counts
from MIN_SENTENCES sentences with together MIN_LETTERS letters; sentences of other languages join the
stretch before them (else after). A text where none counts is one stretch of its best language.

Confidence is the share of the language among all, each weighted by 2 ** -(TRUST * code length): the bits of neighbouring bytes
aren't independent, and with TRUST mean confidence equals accuracy on held-out stretches of 10 and 20 letters.
Runs with digits count only in a text that has nothing else. Null, empty and
letterless texts get one row with null language and confidence 0. Rows are independent, texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leafline.llm.lookalike import table_form, unsure

ORDER = 5
SWITCH = 12.0
TRUST = 0.4
MIN_SENTENCES, MIN_LETTERS = 2, 30
CACHE_ENTRIES = 1_000_000
CACHED_LENGTH = 40

SPACELESS = "぀-ヿ㐀-鿿豈-﫿々"
TOKEN = re.compile(rf"[{SPACELESS}]+|[^\W{SPACELESS}](?:[^\s{SPACELESS}]*[^\W{SPACELESS}])?")
LETTERS = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"\d")
HAS_SPACELESS = re.compile(f"[{SPACELESS}]")
SENTENCE_END = re.compile(r"[.!?]+(?:\s+|$)|[。！？]+\s*")
START = b"\x00"


def units(text: str) -> list[str]:
    """Words of a text in table form, whatever their length, and for scripts without word spaces each character with the one before, marked by a tab.

    Runs between spaces that hold a digit (numbers, codes, paths, encoded data) are no words of a language.
    """
    out: list[str] = []
    for w in TOKEN.findall(text.lower()):
        if w[0] >= "々":
            out.append("\t" + w[0])
            out.extend([a + "\t" + b for a, b in zip(w, w[1:])])
        elif w.isalpha():
            out.append(w)
        elif not DIGIT.search(w):
            out.extend(LETTERS.findall(w))
    return out


def coded(unit: str) -> tuple[bytes, bytes]:
    """The context a unit begins in, and its bytes."""
    before, tab, after = unit.partition("\t")
    return (START + before.encode(), after.encode()) if tab else (START, unit.encode("utf-8", "replace") + START)


class Models:
    """Frozen context trees of all languages."""

    def __init__(self, samples: Iterable[tuple[str, str]]):
        trees: dict[str, dict[bytes, Counter[int]]] = defaultdict(lambda: defaultdict(Counter))
        for lang, text in samples:
            for unit in units(table_form(text or "")):
                context, data = coded(unit)
                for symbol in data:
                    for order in range(min(ORDER, len(context)) + 1):
                        trees[lang][context[len(context) - order :]][symbol] += 1
                    context = (context + bytes([symbol]))[-ORDER:]
        self.langs = sorted(trees)
        self.cost: list[dict[bytes, tuple[float, dict[int, float]]]] = []
        for lang in self.langs:
            tree = {}
            for context, seen in trees[lang].items():
                total = sum(seen.values()) + len(seen)
                tree[context] = (-math.log2(len(seen) / total), {s: -math.log2(n / total) for s, n in seen.items()})
            self.cost.append(tree)

    def bits(self, unit: str) -> list[float]:
        """Code length of a unit in each language."""
        out = []
        for tree in self.cost:
            context, data = coded(unit)
            total = 0.0
            for symbol in data:
                for order in range(min(ORDER, len(context)), -1, -1):
                    if (node := tree.get(context[len(context) - order :])) is None:
                        continue
                    if (cost := node[1].get(symbol)) is not None:
                        total += cost
                        break
                    total += node[0]
                else:
                    total += 8.0
                context = (context + bytes([symbol]))[-ORDER:]
            out.append(total)
        return out


def count_letters(text: str) -> int:
    return len(text) if text.isalpha() else sum(map(len, LETTERS.findall(text)))


def path(bits: np.ndarray) -> np.ndarray:
    """The language of each sentence (rows) of least total code length with SWITCH for each change."""
    n = len(bits)
    best, back = bits[0].copy(), np.zeros(bits.shape, np.int64)
    for i in range(1, n):
        j = int(best.argmin())
        jump = best[j] + SWITCH
        stay = best <= jump
        back[i] = np.where(stay, np.arange(bits.shape[1]), j)
        best = np.where(stay, best, jump) + bits[i]
    out = np.zeros(n, np.int64)
    out[-1] = best.argmin()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


class Labeller:
    """Labels batches of texts. Runs between spaces are scored once and kept with their code lengths and number of letters.

    Runs in scripts without spaces, with digits, or longer than CACHED_LENGTH are put together from parts and aren't kept whole.
    """

    def __init__(self, models: Models):
        self.models = models
        self.index: dict[str, int] = {}
        self.letters: list[int] = []
        self.rows = np.zeros((1024, len(models.langs)), np.float32)

    def _row(self, key: str, bits: list[float] | np.ndarray, letters: int) -> int:
        at = self.index[key] = len(self.letters)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = bits
        self.letters.append(letters)
        return at

    def _units(self, run: str) -> list[int]:
        known, made = self.index, units(run)
        for u in set(made).difference(known):
            self._row(u, self.models.bits(u), len(u.rpartition("\t")[2]))
        return [known[u] for u in made]

    def _new(self, run: str) -> list[int]:
        """Rows of a run that isn't known."""
        parts = self._units(run)
        letters = count_letters(run)
        if len(run) <= CACHED_LENGTH and not HAS_SPACELESS.search(run) and not DIGIT.search(run):
            return [self._row(run, self.rows[parts].sum(0), letters)]
        left = letters - sum(map(self.letters.__getitem__, parts))
        if left:
            key = f"\n{left}"
            parts.append(self.index[key] if key in self.index else self._row(key, np.zeros(len(self.models.langs)), left))
        return parts

    def label(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float, int, int]]]:
        """For each text its stretches: (start, end, language or -1, confidence, letters of the text, languages of it)."""
        if len(self.index) > CACHE_ENTRIES:
            self.__init__(self.models)
        spans: list[list[tuple[int, int]]] = []
        ids: list[int] = []
        ends: list[int] = []
        exact: list[int] = []
        known = self.index.get
        for t in texts:
            own = []
            t, start = t or "", 0
            clean = t.isascii() or not unsure(letters=True).search(t)
            for end in [*(m.end() for m in SENTENCE_END.finditer(t)), len(t)]:
                if end == start:
                    continue
                sentence = t[start:end]
                own.append((start, end))
                start = end
                runs = (sentence if clean else table_form(sentence)).lower().split()
                found = [known(r, -1) for r in runs]
                if -1 in found:
                    for run, at in zip(runs, found):
                        if at < 0:
                            ids.extend(self._new(run))
                        else:
                            ids.append(at)
                else:
                    ids.extend(found)
                ends.append(len(ids))
                exact.append(-1 if clean else count_letters(sentence))
            spans.append(own)
        edges = np.array([0, *ends])
        starts, empty = edges[:-1], edges[1:] == edges[:-1]
        at_all = np.array([*ids, 0], np.int64)  # one more row, for sentences without any at the end
        each = np.add.reduceat(self.rows[at_all], starts, axis=0) if ends else np.zeros((0, self.rows.shape[1]))
        sizes = np.add.reduceat(np.array(self.letters or [0])[at_all], starts) if ends else np.zeros(0, np.int64)
        if ends and not empty[-1]:  # the extra row went into the last sentence
            each[-1] -= self.rows[0]
            sizes[-1] -= self.letters[0]
        each[empty], sizes[empty] = 0, 0
        sizes = np.where(np.array(exact, np.int64) >= 0, exact, sizes) if ends else sizes
        out, at = [], 0
        for own, t in zip(spans, texts):
            found = self._stretches(own, each[at : at + len(own)], sizes[at : at + len(own)])
            if found[0][2] < 0 < found[0][4]:
                found = [self._codes(t or "", *found[0])]
            out.append(found)
            at += len(own)
        return out

    def _codes(self, text: str, start: int, end: int, lang: int, sure: float, letters: int, n: int) -> tuple[int, int, int, float, int, int]:
        """A text of nothing but runs with digits, by the letters in them."""
        parts = LETTERS.findall(table_form(text).lower())
        bits = np.sum([self.models.bits(w) for w in parts], axis=0)
        return (start, end, lang := int(bits.argmin()), self._confidence(bits, lang), letters, 1) if parts else (start, end, lang, sure, letters, n)

    def _stretches(self, own: list[tuple[int, int]], bits: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int, float, int, int]]:
        letters = int(sizes.sum())
        end = own[-1][1] if own else 0
        whole = bits.sum(0)
        if not letters or whole.max(initial=0.0) < 1e-3:
            return [(0, end, -1, 0.0, letters, 0)]
        first = int(whole.argmin())
        if len(own) > 1 and (bits.argmin(1) != first).any():
            chosen = path(bits)
            good = {lang for lang in set(chosen.tolist()) if (sizes[chosen == lang] > 0).sum() >= MIN_SENTENCES and sizes[chosen == lang].sum() >= MIN_LETTERS}
        else:
            chosen, good = np.full(len(own), first), set()
        if len(good) < 2:
            lang = next(iter(good)) if good else first
            return [(0, end, lang, self._confidence(whole, lang), letters, 1)]
        runs: list[list[int]] = []
        for k, lang in enumerate(chosen.tolist()):
            if runs and (lang == runs[-1][2] or lang not in good):
                runs[-1][1] = k + 1
            elif not runs or runs[-1][2] in good:
                runs.append([k, k + 1, lang])
            else:  # a first stretch of a language that doesn't count joins what follows
                runs[-1][1:] = [k + 1, lang]
        return [(own[a][0], own[b - 1][1], lang, self._confidence(bits[a:b].sum(0), lang), letters, len(good)) for a, b, lang in runs]

    @staticmethod
    def _confidence(bits: np.ndarray, lang: int) -> float:
        return float(1 / np.exp2(np.minimum(TRUST * (bits[lang] - bits), 1000)).sum())


def stretches(df: DataFrame, text: str, keep: list[str], samples: Iterable[tuple[str, str]]) -> DataFrame:
    """``keep`` and (stretch_no, start, end, lang, confidence, letters, n_langs): one row for each stretch of one language.

    ``samples`` are (language, text) pairs, a bounded set; the trees they give are broadcast. Map-only.
    """
    shipped = df.sparkSession.sparkContext.broadcast(Models(samples))
    added = [("stretch_no", T.IntegerType(), pa.int32()), ("start", T.IntegerType(), pa.int32()), ("end", T.IntegerType(), pa.int32()), ("lang", T.StringType(), pa.string()), ("confidence", T.DoubleType(), pa.float64()), ("letters", T.IntegerType(), pa.int32()), ("n_langs", T.IntegerType(), pa.int32())]
    schema = T.StructType([*(df.schema[k] for k in keep), *(T.StructField(n, t) for n, t, _ in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shipped.value)
        langs = [*shipped.value.langs, None]
        for batch in batches:
            take, rows = [], []
            for i, found in enumerate(labeller.label(batch.column(len(keep)).to_pylist())):
                for k, (a, b, lang, sure, letters, n) in enumerate(found):
                    take.append(i)
                    rows.append((k, a, b, langs[lang], sure, letters, n))
            columns = list(zip(*rows)) if rows else [[]] * len(added)
            kept = [c.take(pa.array(take, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(list(c), t) for c, (_, _, t) in zip(columns, added))], [*keep, *(n for n, _, _ in added)])

    return df.select(*keep, text).mapInArrow(run, schema)
