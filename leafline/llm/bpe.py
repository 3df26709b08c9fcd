"""Byte-level BPE of whole texts without a regex.

The texts of a batch become one array of code points. Every code point has a class; a class, with
one or two code points of look-ahead, is a symbol of an seven-state automaton that follows the
pre-tokeniser's grammar (contractions, letters, numbers, other signs, white space, a space that
joins the next run). A symbol is a function from state to state; composition is associative, so
the state before every code point comes from a blocked prefix scan whose steps are look-ups in the
composition table of the automaton's transition monoid. The slices between token starts go through
a cache of finished pair merges. A text's first code point carries a constant function, which
starts the automaton anew.

Null and empty texts give the empty list; blank texts are encoded like any other. Strings that
spell a special token are ordinary text. Repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The code points with the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, NUMBER, OTHER, SPACE_IN, SPACE_LAST, SPACE_JOIN, APOS_ONE, APOS_TWO = range(8)
NEUTRAL, IN_LETTERS, IN_NUMBERS, IN_OTHER, JOINING, ONE_LEFT, TWO_LEFT = STATES = range(7)
BLOCK = 256
CACHE_ENTRIES = 1_000_000


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after ``symbol``, and whether a token starts there (SPACE_IN: unless one goes before)."""
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return NEUTRAL, False
    if symbol in (LETTER, NUMBER, OTHER):
        run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}[symbol]
        return run, state not in (run, JOINING)
    if symbol in (APOS_ONE, APOS_TWO):
        if state in (IN_OTHER, JOINING):
            return IN_OTHER, False
        return (ONE_LEFT if symbol == APOS_ONE else TWO_LEFT), True
    return (JOINING if symbol == SPACE_JOIN else NEUTRAL), True


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Functions of the 8 symbols, and of 8 more for text starts, composition, application, starts, identity."""
    plain = [tuple(step(s, y)[0] for s in STATES) for y in range(8)]
    first = [(f[NEUTRAL],) * 7 for f in plain]
    known: dict[tuple[int, ...], int] = {tuple(STATES): 0}
    todo = [tuple(STATES)]
    while todo:
        f = todo.pop()
        for g in plain + first:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    table = np.array(list(known))
    size = 1 << (len(known) - 1).bit_length()
    compose = np.zeros((size, size), np.uint16)
    for f, i in known.items():
        for g, j in known.items():
            compose[i, j] = known[tuple(g[x] for x in f)]
    starts = np.array([[step(s, y)[1] for y in range(8)] for s in STATES])
    return np.array([known[f] for f in plain + first], np.uint16), compose.ravel(), table.astype(np.uint8), starts, size


def scan(functions: np.ndarray) -> np.ndarray:
    """The composition of all functions up to each position, inclusive."""
    _, compose, _, _, size = automaton()
    n = len(functions)
    if n <= BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[int(out[i - 1]) * size + int(out[i])]
        return out
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, np.uint16)
    padded[:n] = functions
    by_column = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    for j in range(1, BLOCK):
        by_column[j] = compose[by_column[j - 1].astype(np.int32) * size + by_column[j]]
    before = np.zeros(rows, np.uint16)
    before[1:] = scan(by_column[-1])[:-1]
    return np.ascontiguousarray(compose[before.astype(np.int32)[None, :] * size + by_column].T).ravel()[:n]


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point: LETTER, NUMBER, OTHER or SPACE_IN."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE_IN
    return out


def token_starts(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions where a pre-token starts in the concatenated texts; lengths are above 0."""
    kind = classes()[points]
    ends = np.cumsum(lengths)
    firsts = ends - lengths
    following = np.full(len(points), SPACE_IN, np.uint8)
    following[:-1] = kind[1:]
    following[ends - 1] = SPACE_IN
    symbol = kind.copy()
    last = (kind == SPACE_IN) & (following != SPACE_IN)
    symbol[last] = np.where(points[last] == 0x20, SPACE_JOIN, SPACE_LAST)
    apostrophes = np.flatnonzero(points == 0x27)
    if len(apostrophes):
        room = ends[np.searchsorted(ends, apostrophes, "right")] - apostrophes
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = padded[apostrophes + 1], padded[apostrophes + 2]
        one = (room > 1) & np.isin(a, [ord(c) for c in "sdmt"])
        two = (room > 2) & (((a == ord("l")) & (b == ord("l"))) | (((a == ord("v")) | (a == ord("r"))) & (b == ord("e"))))
        symbol[apostrophes[one]] = APOS_ONE
        symbol[apostrophes[two]] = APOS_TWO
    functions, _, table, starts, _ = automaton()
    index = symbol.copy()
    index[firsts] += 8
    after = table[scan(functions[index]), NEUTRAL]
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[firsts] = NEUTRAL
    begins = starts[before, symbol]
    inner = np.flatnonzero((symbol[1:] == SPACE_IN) & (symbol[:-1] == SPACE_IN)) + 1
    inner = np.setdiff1d(inner, firsts, assume_unique=True)
    begins[inner] = False
    return np.flatnonzero(begins)


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def tokens(path: str) -> list[bytes]:
    """The bytes of every id."""
    return sorted(ranks(path), key=ranks(path).__getitem__)


@lru_cache(4)
def token_sizes(path: str) -> np.ndarray:
    return np.array([len(t) for t in tokens(path)], np.int64)


def on_executors(spark: SparkSession, vocabulary: str) -> Callable[[], str]:
    """Gives the vocabulary's path on whatever machine it is called: the file is shipped with the job, once a session."""
    name = os.path.basename(vocabulary)
    if not os.path.exists(vocabulary):
        raise FileNotFoundError(vocabulary)
    if not any(str(f).rsplit("/", 1)[-1] == name for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(vocabulary)
    return lambda: vocabulary if os.path.exists(vocabulary) else SparkFiles.get(name)


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Pair merging, lowest rank first and of equal ranks the leftmost; n log n by a heap over a linked list."""
    if (whole := rank.get(piece)) is not None:
        return [whole]
    n = len(piece)
    part = [piece[i : i + 1] for i in range(n)]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if part[i] is not a or j >= n or part[j] is not b:
            continue
        part[i], part[j] = a + b, b""
        nxt[i] = k = nxt[j]
        if k < n:
            prv[k] = i
            if (r := rank.get(part[i] + part[k])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[k]))
        if (h := prv[i]) >= 0 and (r := rank.get(part[h] + part[i])) is not None:
            heapq.heappush(heap, (r, h, part[h], part[i]))
    out, i = [], 0
    while i < n:
        out.append(rank[part[i]])
        i = nxt[i]
    return out


class Encoder:
    """Encodes batches of texts; keeps finished merges, and forgets them all beyond CACHE_ENTRIES."""

    def __init__(self, vocabulary: str = VOCABULARY):
        self.vocabulary = vocabulary
        self.rank = ranks(vocabulary)
        self.cache: dict[str, tuple[int, ...]] = {}

    def pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The pre-tokens of all texts, their starts in the concatenation, and the count of each text's."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        if not lengths.sum():
            return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = token_starts(points, lengths[lengths > 0])
        at = starts.tolist()
        counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)])))
        return [joined[a:b] for a, b in zip(at, [*at[1:], len(joined)])], starts, counts

    def merged(self, pieces: list[str]) -> list[tuple[int, ...]]:
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        for p in set(pieces).difference(cache):
            cache[p] = tuple(merge(p.encode("utf-8", "replace"), self.rank))
        return [cache[p] for p in pieces]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's."""
        pieces, _, counts = self.pieces(texts)
        merged = self.merged(pieces)
        sizes = np.fromiter(map(len, merged), np.int64, len(merged))
        ids = np.fromiter(chain.from_iterable(merged), np.int32, int(sizes.sum()))
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(counts)])])

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of each text's ids."""
        pieces, _, counts = self.pieces(texts)
        total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, self.merged(pieces)), np.int64, len(pieces)))])
        return np.diff(total[np.concatenate([[0], np.cumsum(counts)])])

    def ends(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Where each token ends, in bytes of its text's UTF-8."""
        total = np.concatenate([[0], np.cumsum(token_sizes(self.vocabulary)[ids])])
        firsts = np.cumsum(counts) - counts
        return (total[1:] - np.repeat(total[firsts], counts)).astype(np.int32) if len(ids) else np.zeros(0, np.int32)

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of each token of a text, in bytes of its UTF-8."""
        ids, counts = self.encode([text])
        ends = self.ends(ids, counts).tolist()
        return list(zip(ids.tolist(), [0, *ends[:-1]], ends))

    def decode(self, ids: list[int]) -> str:
        back = tokens(self.vocabulary)
        return b"".join([back[i] for i in ids]).decode("utf-8", "replace")


CHARS_AT_ONCE = 2_000_000


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about CHARS_AT_ONCE characters together; a longer text is a run of its own."""
    part: list[str] = []
    held = 0
    for t in texts:
        if part and held + len(t) > CHARS_AT_ONCE:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def encode_texts(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY, ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """``keep`` and the ids of ``text``, one row for each row of ``df``; map-only, no shuffle.

    With ``offsets``, a column of that name holds where each token ends, in bytes of the text's UTF-8. Null and empty texts have the
    empty list. Other columns of ``df`` aren't read.
    """
    lists = [ids] + ([offsets] if offsets else [])
    schema = T.StructType([*(df.schema[k] for k in keep), *(T.StructField(n, T.ArrayType(T.IntegerType(), False), False) for n in lists)])
    path = on_executors(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path())
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            done = [encoder.encode(g) for g in groups(texts)]
            flat = np.concatenate([np.zeros(0, np.int32), *(d[0] for d in done)])
            counts = np.concatenate([np.zeros(0, np.int64), *(d[1] for d in done)])
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            made = [flat] + ([encoder.ends(flat, counts)] if offsets else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.ListArray.from_arrays(ends, pa.array(m, pa.int32())) for m in made)], [*keep, *lists])

    return df.select(*(F.col(k) for k in keep), F.col(text).alias("\0text")).mapInArrow(run, schema)


def decode_texts(df: DataFrame, ids: str, ends: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep``, ``ids`` and ``decoded``: the text of the ids, null where the ends aren't those of the ids' bytes; map-only."""
    schema = T.StructType([*(df.schema[k] for k in keep), df.schema[ids], T.StructField("decoded", T.StringType())])
    path = on_executors(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path())
        sizes = token_sizes(encoder.vocabulary)
        for batch in batches:
            found = []
            for numbers, at in zip(batch.column(len(keep)), batch.column(len(keep) + 1)):
                n = numbers.values.to_numpy()
                found.append(encoder.decode(n.tolist()) if np.array_equal(np.cumsum(sizes[n]), at.values.to_numpy()) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], schema.names)

    return df.select(*keep, ids, ends).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY, count: str = "n_tokens") -> DataFrame:
    """``keep`` and the number of tokens of ``text`` (0 for null and empty), one row for each row of ``df``."""
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField(count, T.LongType(), False)])
    path = on_executors(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path())
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            sizes = np.concatenate([np.zeros(0, np.int64), *(encoder.count(g) for g in groups(texts))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*keep, count])

    return df.select(*keep, text).mapInArrow(run, schema)
