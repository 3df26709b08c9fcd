"""Long exact spans shared between records, by a count-min prefilter.

Windows. Every text gives the fingerprints (64-bit hashes) of some of its grams of GRAM code points: in
each run of span - GRAM + 1 consecutive grams the one with the smallest hash, the last of equal
ones. A run is a window of ``span`` code points, so each window has one anchor, and equal windows have equal anchors.
All windows of one anchor follow each other and make up its region.

First pass. Each partition counts its fingerprints, once a record, in a count-min sketch of two rows: it
sends the slots it met once and those it met more often, and the slots merge by addition into one bit a
slot, 'met at least twice'. Counts are only ever too high, so no repeated window is lost. Both rows of a fingerprint lie in
one chunk of slots, and the number of chunks follows the number of anchors. Up to 2**MAX_BITS slots a row (64 MB, LEAST slots an anchor)
the bits are broadcast; beyond, each chunk's bits meet the fingerprints of the chunk in a task, and no machine holds them all. The rows are the same.

Second pass. Only regions of fingerprints that the sketch estimates to be repeated are written, and grouped exactly:

1. Equal regions (128-bit hashes) are one class, with the smallest and largest id and a signature of the set of its ids, by
   partial aggregation. A class of several ids shares all its windows.
2. Where an anchor has several classes, those that share a window agree, around the anchor, in at least one of PARTS
   stretches of nearly its length (for what a window has on the left of its anchor it lacks on the right). One region
   of each class that agrees so with another is cut into its windows, and windows that several classes have join them.
3. Classes and windows with the same set of ids are one set, which gives its pairs once.

So a text of any length that very many records have costs one row a record and anchor, and pairs once. ``shared_spans``
and ``shared_shares`` form no pairs at all.

Null and empty texts, and texts shorter than ``span``, share nothing. Rows with the same id are one record (identical
rows; of others with the same id all texts count); a null id takes no part. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafline.session import scratch

GRAM = 100
MAX_BITS = 28
CHUNK_BITS = 16
LEAST = 2
PARTS = 4
CHARS_AT_ONCE = 1_500_000
BASE = 0x9E3779B97F4A7C15  # any odd number


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Polynomial hashes of all windows of a string, from prefix sums modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def prefix(self, points: np.ndarray) -> np.ndarray:
        n = len(points) + 1
        if len(self.up) < n:
            self.up, self.down = _powers(2 * n, BASE), _powers(2 * n, pow(BASE, -1, 1 << 64))
        out = np.zeros(n, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(0x1234567)) * self.down[: n - 1], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, width: int, starts: np.ndarray | None = None) -> np.ndarray:
        """Hash of the window at each start (at all, without ``starts``)."""
        if starts is None:
            h = (prefix[width:] - prefix[:-width]) * self.up[width - 1 : len(prefix) - 1]
        else:
            h = (prefix[starts + width] - prefix[starts]) * self.up[starts + width - 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h


def sliding(values: np.ndarray, width: int, best: np.ufunc, filler: int) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``width`` consecutive values."""
    n = len(values)
    rows = -(-n // width)
    blocks = np.full(rows * width, filler, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(rows, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - width + 1], ahead[width - 1 : n])


def select(hashes: np.ndarray, lengths: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The selected grams in the concatenation of texts, each of at least ``span``: their positions, the first window of each, and the number of its windows."""
    run = span - gram + 1
    mask = np.uint64((1 << len(hashes).bit_length()) - 1)
    keys = (hashes & ~mask) | (mask - np.arange(len(hashes), dtype=np.uint64))
    least = sliding(keys, run, np.minimum, 0)
    valid = np.ones(len(least), bool)
    for end in np.cumsum(lengths)[:-1].tolist():
        valid[max(0, end - span + 1) : end] = False
    chosen = (mask - (least[valid] & mask)).astype(np.int64)
    new = np.flatnonzero(np.diff(chosen, prepend=-1))
    return chosen[new], np.flatnonzero(valid)[new], np.diff(new, append=len(chosen))


Batch = tuple[list, list[str], np.ndarray, str, np.ndarray, Hasher]


def _batches(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[Batch]:
    """(ids, texts, ends, concatenation, its code points, hasher) of runs of texts of at least ``span``."""
    hasher = Hasher()

    def flush(ids: list, texts: list[str]) -> Batch:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        return ids, texts, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))), joined, points, hasher

    for batch in batches:
        ids, texts, held = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if texts and held + len(t) > CHARS_AT_ONCE:
                yield flush(ids, texts)
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t)
        if texts:
            yield flush(ids, texts)


Anchors = tuple[np.ndarray, ...]


def _anchors(batch: Batch, span: int) -> Anchors:
    """Hashes and record numbers of a batch's selected grams, their first windows and numbers of windows, and their positions."""
    _, _, ends, _, points, hasher = batch
    prefix = hasher.prefix(points)
    hashes = hasher.windows(prefix, GRAM)
    at, first, count = select(hashes, np.diff(ends, prepend=0), span, GRAM)
    return hashes[at], np.searchsorted(ends, at, "right"), first, count, at


def _once(batch: Batch, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Each hash of a batch's selected grams once a record, and the record numbers."""
    hashes, record, *_ = _anchors(batch, span)
    order = np.lexsort((hashes, record))
    hashes, record = hashes[order], record[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (record[1:] != record[:-1])
    return hashes[new], record[new]


SLOTS = 1 << CHUNK_BITS
BYTES = SLOTS >> 3


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The chunk of each hash, and its slot in the chunk for either row, in a sketch of 2**bits slots a row."""
    a, b = (hashes * np.uint64(m) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
    inner = np.uint64(SLOTS - 1)
    chunk = (a >> np.uint64(64 - bits + CHUNK_BITS)) if bits > CHUNK_BITS else np.zeros_like(a)
    return chunk.astype(np.int64), (((a >> np.uint64(64 - bits)) & inner).astype(np.int64), (b >> np.uint64(64 - CHUNK_BITS)).astype(np.int64))


def merged_sketch(texts: DataFrame, span: int, bits: int) -> DataFrame:
    """(chunk, bits): of every chunk of the merged sketch one bit a slot for either row, set where the slot was met at least twice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate([np.zeros(0, np.uint64), *(_once(batch, span)[0] for batch in _batches(batches, span))])
        chunk, rows = _slots(every, bits)
        for row, inner in enumerate(rows):
            slots, n = np.unique((chunk << CHUNK_BITS) | inner, return_counts=True)
            names, firsts = np.unique(slots >> CHUNK_BITS, return_index=True)
            inner = (slots & (SLOTS - 1)).astype(np.uint16)
            once, more = [], []
            for a, b in zip(firsts, [*firsts[1:], len(slots)]):
                once.append(inner[a:b][n[a:b] == 1].tobytes())
                more.append(inner[a:b][n[a:b] > 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), row), pa.int32()), pa.array(names, pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["row", "chunk", "once", "more"])

    def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, twice = np.zeros((2, SLOTS), bool), np.zeros((2, SLOTS), bool)
        for part in parts:
            for row, a, b in zip(part.column("row").to_pylist(), part.column("once").to_pylist(), part.column("more").to_pylist()):
                slots = np.frombuffer(a, np.uint16)
                twice[row, slots] |= seen[row, slots]
                seen[row, slots] = True
                slots = np.frombuffer(b, np.uint16)
                seen[row, slots] = twice[row, slots] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["chunk", "bits"])

    add.__annotations__ = {"key": tuple[pa.Scalar, ...], "parts": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return texts.mapInArrow(count, "row int, chunk long, once binary, more binary").groupBy("chunk").applyInArrow(add, "chunk long, bits binary")


def _met(bits: np.ndarray, chunk: np.ndarray, rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether both slots of each hash are set in ``bits`` (chunks x 2 x BYTES)."""
    keep = np.ones(len(chunk), bool)
    for row, inner in enumerate(rows):
        keep &= (bits[chunk, row, inner >> 3] >> (7 - (inner & 7)).astype(np.uint8)) & 1 == 1
    return keep


def repeated_slots(texts: DataFrame, span: int, bits: int) -> np.ndarray:
    """The merged sketch as one array, for sizes that are broadcast."""
    out = np.zeros((1 << max(0, bits - CHUNK_BITS), 2, BYTES), np.uint8)
    for r in merged_sketch(texts, span, bits).toLocalIterator():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8).reshape(2, BYTES)
    return out


def _repeated(hashes: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return _met(sketch, *_slots(hashes, len(sketch).bit_length() - 1 + CHUNK_BITS))


def _marked(texts: DataFrame, span: int, bits: int) -> DataFrame:
    """``texts`` with ``marks``, the fingerprints of each that the sketch estimates to be repeated, for a sketch that no machine holds: chunks meet their fingerprints."""
    kind = texts.schema["id"].dataType

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, span):
            hashes, record = _once(batch, span)
            yield pa.RecordBatch.from_arrays([pa.array(_slots(hashes, bits)[0], pa.int64()), pa.array(hashes.view(np.int64)), _ids(batch[0], record, kind)], ["chunk", "f", "id"])

    def keep(key: tuple[pa.Scalar, ...], found: pa.Table, sketch: pa.Table) -> pa.Table:
        hashes = found.column("f").to_numpy().view(np.uint64)
        chunk, rows = _slots(hashes, bits)
        held = np.frombuffer(sketch.column("bits")[0].as_py(), np.uint8).reshape(1, 2, BYTES) if sketch.num_rows else np.zeros((1, 2, BYTES), np.uint8)
        return found.select(["f", "id"]).filter(pa.array(_met(held, np.zeros_like(chunk), rows)))

    found = texts.mapInArrow(fingerprints, T.StructType([T.StructField("chunk", T.LongType()), T.StructField("f", T.LongType()), T.StructField("id", kind)]))
    kept = found.groupBy("chunk").cogroup(merged_sketch(texts, span, bits).groupBy("chunk")).applyInArrow(keep, T.StructType([T.StructField("f", T.LongType()), T.StructField("id", kind)]))
    return texts.join(kept.groupBy("id").agg(F.collect_set("f").alias("marks")).hint("merge"), "id")


def _ids(ids: list, record: np.ndarray, kind: T.DataType) -> pa.Array:
    return pa.array([ids[r] for r in record.tolist()], pa.int64() if isinstance(kind, T.LongType) else None)


class Shared:
    """Classes of equal regions and windows that several of them have, in tables in the shared folder.

    ``regions`` (f, r, id, start, n, text): the regions of repeated anchors; ``classes`` (f, r, lo, hi, k and the signature): the
    distinct ones with at least two ids or another class of their anchor; ``windows`` (w, f, r, at and the same): the windows of
    classes of anchors with several.
    """

    SIGN = ("s0", "s1", "s2", "s3")

    def __init__(self, df: DataFrame, item: str, text: str, span: int):
        if span < GRAM:
            raise ValueError(f"span must be at least {GRAM}")
        spark = df.sparkSession
        self.kind = df.schema[item].dataType
        path = scratch(spark, "spans")
        texts = df.select(F.col(item).alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull() & (F.char_length("text") >= span))
        chars = texts.agg(F.sum(F.char_length("text"))).first()[0] or 0
        anchors = 2 * chars / (span - GRAM + 2) + 1
        bits = max(CHUNK_BITS, math.ceil(math.log2(8 * anchors)))
        schema = T.StructType([T.StructField("f", T.LongType()), T.StructField("r", T.BinaryType()), T.StructField("id", self.kind), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("near", T.ArrayType(T.LongType())), T.StructField("text", T.StringType())])
        kind = self.kind
        around = _around(span)

        def regions(batch: Batch, anchors: Anchors, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
            ids, _, ends, joined, _, _ = batch
            hashes, record, first, count, at = (a[keep] for a in anchors)
            cut = [joined[a:b] for a, b in zip(first.tolist(), (first + count + span - 1).tolist())]
            begins = ends - np.diff(ends, prepend=0)
            columns = [pa.array(hashes.view(np.int64)), pa.array([_digest(c) for c in cut], pa.binary()), _ids(ids, record, kind), pa.array((first - begins[record]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array([_near(c, p, around) for c, p in zip(cut, (at - first).tolist())], pa.list_(pa.int64())), pa.array(cut, pa.string())]
            yield from pa.Table.from_arrays(columns, schema.names).to_batches()

        if LEAST * anchors <= 1 << MAX_BITS:
            sketch = spark.sparkContext.broadcast(repeated_slots(texts, span, min(bits, MAX_BITS)))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in _batches(batches, span):
                    found = _anchors(batch, span)
                    yield from regions(batch, found, _repeated(found[0], sketch.value))

            written = texts.mapInArrow(run, schema)
        else:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part in batches:
                    marks = iter(part.column(2))
                    for batch in _batches(iter([part.select(["id", "text"])]), span):
                        found = _anchors(batch, span)
                        edges = np.searchsorted(found[1], np.arange(len(batch[0]) + 1))
                        own = [np.isin(found[0][a:b].view(np.int64), next(marks).values.to_numpy()) for a, b in zip(edges, edges[1:])]
                        yield from regions(batch, found, np.concatenate(own) if own else np.zeros(0, bool))

            written = _marked(texts, span, bits).select("id", "text", "marks").mapInArrow(run, schema)
        written.write.parquet(f"{path}/regions")
        self.regions = spark.read.parquet(f"{path}/regions")

        h, g = F.xxhash64("id"), F.xxhash64("id", F.lit(1))
        low, high = (lambda c: F.sum(c.bitwiseAND((1 << 32) - 1))), (lambda c: F.sum(F.shiftrightunsigned(c, 32)))
        each = self.regions.groupBy("f", "r").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("s0"), low(h).alias("s1"), high(h).alias("s2"), low(g).alias("s3"))
        each.write.parquet(f"{path}/each")
        each = spark.read.parquet(f"{path}/each")
        anchor = each.groupBy("f").agg(F.count("*").alias("k"), F.min("lo").alias("x"), F.max("hi").alias("y")).filter("x <> y").select("f", "k")
        each.join(anchor, "f").write.parquet(f"{path}/classes")
        self.classes = spark.read.parquet(f"{path}/classes")

        several = self.classes.filter("k > 1")
        near = self.regions.select("f", "r", F.col("id").alias("lo"), "near").join(several.select("f", "r", "lo", "hi"), ["f", "r", "lo"])
        near.select("f", "r", "lo", "hi", F.explode("near").alias("near")).distinct().write.parquet(f"{path}/near")
        near = spark.read.parquet(f"{path}/near")
        agreed = near.groupBy("near").agg(F.count("*").alias("c"), F.min("lo").alias("x"), F.max("hi").alias("y")).filter("c > 1 and x <> y").select("near")
        near.join(agreed, "near").select("f", "r").distinct().write.parquet(f"{path}/agreed")
        several = several.join(spark.read.parquet(f"{path}/agreed"), ["f", "r"])
        one = self.regions.select("f", "r", F.col("id").alias("lo"), "text").join(several, ["f", "r", "lo"]).dropDuplicates(["f", "r"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, take, at = [], [], []
                for row, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    n = len(t) - span + 1
                    keys += [_digest(t[k : k + span]) for k in range(n)]
                    take += [row] * n
                    at += range(n)
                rows = pa.Table.from_batches([batch]).drop(["text"]).take(pa.array(take, pa.int64()))
                yield from rows.append_column("w", pa.array(keys, pa.binary())).append_column("at", pa.array(at, pa.int32())).to_batches(max_chunksize=100_000)

        names = ["f", "r", "lo", "hi", *self.SIGN]
        fields = [several.schema[c] for c in names]
        one.select(*names, "text").mapInArrow(cut, T.StructType([*fields, T.StructField("w", T.BinaryType()), T.StructField("at", T.IntegerType())])).write.parquet(f"{path}/windows")
        self.windows = spark.read.parquet(f"{path}/windows")

    def joint(self) -> DataFrame:
        """(w and a signature) of windows that several classes and ids have."""
        sums = [F.sum(c).alias(c) for c in self.SIGN]
        return self.windows.groupBy("w").agg(F.count("*").alias("c"), F.min("lo").alias("x"), F.max("hi").alias("y"), *sums).filter("c > 1 and x <> y").select("w", *self.SIGN)

    def sets(self) -> DataFrame:
        """(s0.., id): the distinct sets of ids that share something, and their members."""
        members = self.regions.select("f", "r", "id")
        whole = self.classes.filter("lo <> hi").groupBy(*self.SIGN).agg(F.min(F.struct("f", "r")).alias("c")).select(*self.SIGN, "c.f", "c.r")
        joint = self.joint().groupBy(*self.SIGN).agg(F.min("w").alias("w")).join(whole.select(*self.SIGN), list(self.SIGN), "left_anti")
        of_windows = joint.join(self.windows.select("w", "f", "r"), "w").select(*self.SIGN, "f", "r")
        return whole.unionByName(of_windows).join(members, ["f", "r"]).select(*self.SIGN, "id").distinct()

    def starts(self) -> DataFrame:
        """(id, start, n): n windows from ``start`` on stand in another record too."""
        whole = self.regions.join(self.classes.filter("lo <> hi").select("f", "r"), ["f", "r"]).select("id", "start", "n")
        single = self.windows.filter("lo = hi").join(self.joint().select("w"), "w").select("f", "r", "at")
        return whole.unionByName(self.regions.join(single, ["f", "r"]).select("id", (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("n"))).distinct()


def _around(span: int) -> list[tuple[int, int]]:
    """How far to the left and right of its gram a window reaches at least, in PARTS cases of which one always holds."""
    extra = span - GRAM
    part = max(1, -(-extra // PARTS))
    return sorted({(min(i * part, extra), max(0, extra - (i + 1) * part)) for i in range(PARTS)})


def _near(region: str, at: int, around: list[tuple[int, int]]) -> list[int]:
    """Hashes of the stretches around the gram at ``at`` that lie in the region."""
    cut = [region[at - a : at + GRAM + b] for a, b in around if a <= at and at + GRAM + b <= len(region)]
    return [xxhash.xxh3_64_intdigest(c.encode("utf-32-le", "surrogatepass")) - (1 << 63) for c in cut]


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-32-le", "surrogatepass"))


def shared_pairs(df: DataFrame, item: str, text: str, span: int = 200) -> DataFrame:
    """(id_a, id_b), a < b, for all records that share ``span`` code points in a row; each set of records gives its pairs once."""
    sets = Shared(df, item, text, span).sets()
    a, b = sets.withColumnRenamed("id", "id_a"), sets.withColumnRenamed("id", "id_b")
    return a.join(b, list(Shared.SIGN)).filter("id_a < id_b").select("id_a", "id_b").distinct()


def shared_sets(df: DataFrame, item: str, text: str, span: int = 200) -> DataFrame:
    """(set_id, item): the sets of records that share at least ``span`` code points in a row, without pairs; a record may be in several."""
    return Shared(df, item, text, span).sets().select(F.concat_ws("-", *Shared.SIGN).alias("set_id"), F.col("id").alias(item))


def shared_starts(df: DataFrame, item: str, text: str, span: int = 200) -> DataFrame:
    """(id, start) of every window of ``span`` code points that stands in another record too."""
    found = Shared(df, item, text, span).starts()
    return found.select("id", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("start")).distinct()


def _stretches(df: DataFrame, item: str, text: str, span: int) -> DataFrame:
    """(id, start, end): disjoint stretches, whole by whole, of windows that stand in another record too."""
    order = Window.partitionBy("id").orderBy("start", "n")
    runs = Shared(df, item, text, span).starts().withColumn("stop", F.col("start") + F.col("n"))
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = runs.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "run").agg(F.min("start").alias("start"), (F.max("stop") + span - 1).alias("end"))


def shared_spans(df: DataFrame, item: str, text: str, span: int = 200) -> DataFrame:
    """(id, start, end) of the stretches in which every ``span`` code points stand in another record."""
    return _stretches(df, item, text, span).select(F.col("id").alias(item), "start", "end")


def shared_shares(df: DataFrame, item: str, text: str, span: int = 200) -> DataFrame:
    """(id, covered, share) of every record: how many of its code points shared stretches cover; 0 where none, share 0 for empty and null texts."""
    order = Window.partitionBy("id").orderBy("start")
    ahead = F.coalesce(F.lead("start").over(order), F.col("end"))
    covered = _stretches(df, item, text, span).withColumn("adds", F.least(F.col("end"), ahead) - F.col("start")).groupBy("id").agg(F.sum("adds").alias("covered"))
    sizes = df.select(F.col(item).alias("id"), F.coalesce(F.char_length(text), F.lit(0)).alias("size")).groupBy("id").agg(F.max("size").alias("size"))
    return sizes.join(covered, "id", "left").select(F.col("id").alias(item), F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce(F.try_divide("covered", "size"), F.lit(0.0)).alias("share"))
