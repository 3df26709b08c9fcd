"""The most similar vectors of every vector, by additive quantisation.

Model. A bounded sample (SAMPLE rows, those with the smallest hashes of their ids) gives coarse centroids and
BOOKS additive codebooks of WORDS full-dimensional words each for the residuals: residual k-means first, then
rounds of beam-search encoding and least squares over all codebooks together. Every vector is indexed; only
the model is fitted on the sample, and its size depends on the parameters alone.

Cells. The number of centroids follows the square root of the vectors, as far as the sample can carry them. Where that leaves
more than FULL vectors a cell on average, every cell is parted by the words of the first codebook, WORDS times finer, which needs no more sample.

Search. Every vector is put in its nearest cell with its beam-searched code and the norm of what the code
decodes to. It queries its nearest cells: look-up tables of inner products between the query and all words score the codes there,
and the RERANK best of a cell, four times as many of a group of cells, are compared exactly. How many cells are queried is measured, not set: ASKED vectors are compared with
all vectors, in blocks, and as many cells are taken as hold TARGET of their true neighbours. So vectors without clusters
are searched in most cells, at its cost, and recall is kept.

Work. Cells near each other form groups of some thousand vectors, and a query travels once to each group, with the list of its
cells there, so it meets codes and exact vectors in one place. Groups are cut into blocks and their queries into chunks, so
the unit of work is bounded however the vectors crowd.

Copies. Equal vectors are one node of the index that names its k + 1 smallest ids, so any number of copies
costs as much as one.

A vector is usable if it has exactly ``dimension`` finite values, not all 0; other rows take no part. Rows with a null id
take no part. Rows delivered twice count once. Of equal similarities the smaller id goes first. Fewer than k + 1
usable vectors give fewer neighbours; none give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.session import scratch

SAMPLE = 20_000
BOOKS, WORDS, BEAM = 8, 64, 4
RERANK = 48
ASKED, TARGET = 256, 0.99
BLOCK, CHUNK = 32_768, 65_536
MAX_CELLS, FULL = 4096, 32_768


@dataclass
class Model:
    cells: np.ndarray  # cells x dimension
    books: np.ndarray  # BOOKS x WORDS x dimension
    parts: int = 1  # 1, or WORDS if cells are parted by the first codebook

    def centre(self, cell: np.ndarray) -> np.ndarray:
        """The centroids that residuals in the cells are taken from."""
        return self.cells[cell // self.parts]

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each unit vector, nearest first."""
        s = 2 * x @ self.cells.T - (self.cells**2).sum(1)
        if self.parts == 1:
            return _largest(s, n)
        coarse = _largest(s, max(1, min(n, len(self.cells))))
        inner = 2 * x @ self.books[0].T - (self.books[0] ** 2).sum(1)
        each = np.take_along_axis(s, coarse, 1)[:, :, None] + inner[:, None, :] - 2 * (self.cells @ self.books[0].T)[coarse]
        best = _largest(each.reshape(len(x), -1), n)
        return np.take_along_axis(coarse, best // self.parts, 1) * self.parts + best % self.parts

    def encode(self, residual: np.ndarray) -> np.ndarray:
        """Beam-searched codes (n x BOOKS) of residuals."""
        n, d = residual.shape
        beams, codes = residual[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            cost = (book**2).sum(1) - 2 * (beams.reshape(-1, d) @ book.T).reshape(n, beams.shape[1], -1) + (beams**2).sum(2)[:, :, None]
            flat = cost.reshape(n, -1)
            keep = min(BEAM, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, word = best // len(book), best % len(book)
            beams = np.take_along_axis(beams, parent[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        last = (beams**2).sum(2).argmin(1)
        return codes[np.arange(n), last]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))


def _largest(s: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest values of each row, largest first."""
    n = min(n, s.shape[1])
    part = np.argpartition(-s, n - 1, axis=1)[:, :n]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable"), 1)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    centre = x[np.random.default_rng(seed).choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (2 * x @ centre.T - (centre**2).sum(1)).argmax(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return centre


def fit(x: np.ndarray, n: int) -> Model:
    """A model from unit vectors of the sample, for n vectors in all."""
    cells = min(MAX_CELLS, max(1, len(x) // 4), 1 << int(np.log2(max(1.0, n**0.5))))
    model = Model(_kmeans(x, cells, 12, 1), np.zeros((0, WORDS, x.shape[1]), np.float32))
    residual = x - model.centre(model.nearest(x, 1)[:, 0])
    left, books = residual.copy(), []
    for m in range(BOOKS):
        book = _kmeans(left, WORDS, 6, m)
        left -= book[(2 * left @ book.T - (book**2).sum(1)).argmax(1)]
        books.append(book)
    model.books = np.stack(books)
    for _ in range(2):
        codes = model.encode(residual)
        design = np.zeros((len(x), BOOKS * WORDS), np.float32)
        for m in range(BOOKS):
            design[np.arange(len(x)), m * WORDS + codes[:, m].astype(np.int64)] = 1
        gram = design.T @ design + 0.1 * np.eye(BOOKS * WORDS, dtype=np.float32)
        model.books = np.linalg.solve(gram, design.T @ residual + 0.1 * model.books.reshape(-1, x.shape[1])).astype(np.float32).reshape(model.books.shape)
    model.parts = WORDS if n > FULL * cells else 1
    return model


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def usable(vector: str, dimension: int) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) == dimension) & finite & F.exists(vector, lambda v: v != 0)


def search_unit(model: Model, data: pd.DataFrame, query: pd.DataFrame, k: int, dimension: int) -> pd.DataFrame:
    """The k best of some cells for each query that asks one of them: (q, node, sim)."""
    data = data.sort_values("cell", kind="stable")
    x = np.frombuffer(b"".join(data["vec"]), np.float32).reshape(-1, dimension)
    codes = np.frombuffer(b"".join(data["code"]), np.uint8).reshape(-1, BOOKS)
    nodes, norms = data["node"].to_numpy(), data["norm"].to_numpy(np.float32)
    cells, firsts = np.unique(data["cell"].to_numpy(), return_index=True)
    bounds = dict(zip(cells.tolist(), zip(firsts.tolist(), [*firsts[1:].tolist(), len(data)])))
    parts = []
    for a in range(0, len(query), 4096):
        some = query.iloc[a : a + 4096]
        asked = some["node"].to_numpy()
        y = np.frombuffer(b"".join(some["vec"]), np.float32).reshape(-1, dimension)
        tables = [y @ book.T for book in model.books]
        wanted = np.concatenate([np.asarray(c) for c in some["cells"]])
        who = np.repeat(np.arange(len(some)), [len(c) for c in some["cells"]])
        order = np.argsort(wanted, kind="stable")
        names, starts = np.unique(wanted[order], return_index=True)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for cell, b, e in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
            if cell not in bounds:
                continue
            lo, hi = bounds[cell]
            step = max(1, 2_000_000 // (hi - lo))
            n = min(RERANK, hi - lo)
            centre = model.cells[cell // model.parts]
            for c in range(b, e, step):
                q = who[order[c : min(e, c + step)]]
                score = np.repeat((y[q] @ centre)[:, None], hi - lo, 1)
                for m, table in enumerate(tables):
                    score += np.take(table[q], codes[lo:hi, m], axis=1)
                score /= norms[lo:hi]
                best = np.argpartition(-score, n - 1, axis=1)[:, :n]
                found.append((np.repeat(q, n), (lo + best).ravel(), np.take_along_axis(score, best, 1).ravel()))
        if not found:
            continue
        q, row, score = (np.concatenate(c) for c in zip(*found))
        other = asked[q] != nodes[row]
        q, row, score = q[other], row[other], score[other]

        def first(q: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
            """The n best of each q."""
            order = np.lexsort((-by, q))
            sizes = np.bincount(q, minlength=len(some))
            rank = np.arange(len(q)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            return order[rank < n]

        keep = first(q, score, 4 * RERANK)
        q, row = q[keep], row[keep]
        exact = np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", y[q[c : c + 200_000]].astype(np.float64), x[row[c : c + 200_000]].astype(np.float64)) for c in range(0, len(q), 200_000))])
        keep = first(q, exact, k)
        parts.append(pd.DataFrame({"q": asked[q[keep]], "node": nodes[row[keep]], "sim": exact[keep]}))
    return pd.concat(parts) if parts else pd.DataFrame({"q": [], "node": [], "sim": []})


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension))


def probes_needed(nodes: DataFrame, model: Model, asked: np.ndarray, own: np.ndarray, k: int) -> int:
    """How many cells hold TARGET of the true k neighbours of the ``asked`` vectors among all ``nodes``, which are read once, in blocks."""
    dimension = asked.shape[1]
    shipped = nodes.sparkSession.sparkContext.broadcast((model, asked, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, asked, own = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _vectors(batch.column(1), dimension), batch.column(0).to_numpy()
            s = asked @ x.T
            s[own[:, None] == ids[None, :]] = -2
            best = _largest(s, k)
            cell = model.nearest(x[best.ravel()], 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asked)), best.shape[1]), pa.int32()), pa.array(np.take_along_axis(s, best, 1).ravel(), pa.float32()), pa.array(cell, pa.int64())], ["q", "sim", "cell"])

    order = Window.partitionBy("q").orderBy(F.desc("sim"), "cell")
    true = nodes.select("node", "v").mapInArrow(run, "q int, sim float, cell long").filter("sim > -2").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).collect()  # at most ASKED * k rows
    n_cells = len(model.cells) * model.parts
    if not true:
        return 1
    # Only as many cells are ranked as the answer needs: twice as many in each round.
    most = min(n_cells, 64)
    while True:
        near = model.nearest(asked, most)
        ranks = []
        for r in true:
            at = np.flatnonzero(near[r["q"]] == r["cell"])
            ranks.append(int(at[0]) if len(at) else n_cells)
        need = int(np.sort(ranks)[max(0, int(np.ceil(TARGET * len(ranks))) - 1)]) + 1
        if need <= most or most == n_cells:
            return min(need, n_cells)
        most = min(n_cells, 4 * most)


def most_similar(df: DataFrame, item: str, vector: str, k: int = 5, dimension: int = 64, probes: int | None = None) -> DataFrame:
    """(item, neighbour, cosine, rank) of the k most similar of every usable vector; ``probes`` cells are queried, by default as many as ``probes_needed`` tells."""
    spark = df.sparkSession
    found = df.filter(F.col(item).isNotNull() & usable(vector, dimension)).select(F.col(item).alias("id"), F.transform(vector, lambda v: v.cast("float")).alias("v"))
    keyed = found.select("id", "v", F.xxhash64("v").alias("h1"), F.hash(F.reverse("v")).alias("h2"), F.xxhash64(F.reverse("v")).alias("h3"))
    key = ["h1", "h2", "h3"]
    ids = keyed.select("id", *key).distinct()
    least = keyed.withColumn("r", F.dense_rank().over(Window.partitionBy(*key).orderBy("id"))).filter(F.col("r") <= k + 1)
    nodes = least.groupBy(*key).agg(F.first("v").alias("v"), F.array_sort(F.collect_set("id")).alias("ids")).withColumn("node", F.monotonically_increasing_id())
    path = scratch(spark, "nodes")
    nodes.write.parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")
    n = nodes.count()
    sample = nodes.select("h1", "node", "v").orderBy("h1").limit(SAMPLE).collect()
    if not sample:
        kind = df.schema[item].dataType.simpleString()
        return spark.createDataFrame([], f"`{item}` {kind}, neighbour {kind}, cosine double, rank int")
    x = unit([r["v"] for r in sample])
    model = fit(x, n)
    probes = probes or probes_needed(nodes, model, x[:ASKED], np.array([r["node"] for r in sample[:ASKED]]), k)
    shipped = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1), dimension)
            cell = model.nearest(x, 1)[:, 0]
            base = model.centre(cell)
            codes = model.encode(x - base)
            norms = np.linalg.norm(base + model.decode(codes), axis=1)
            raw = [r.tobytes() for r in np.ascontiguousarray(x)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(np.maximum(norms, 1e-6), pa.float32()), pa.array(cell, pa.int64())], ["node", "vec", "code", "norm", "cell"])

    nodes.select("node", "v").mapInArrow(encode, "node long, vec binary, code binary, norm float, cell long").write.parquet(f"{path}/codes")
    codes = spark.read.parquet(f"{path}/codes")
    # Groups of neighbouring coarse cells; there are at most MAX_CELLS of these, so what is collected is bounded.
    size = max(2048, min(BLOCK, n // (3 * spark.sparkContext.defaultParallelism)))
    centre = _kmeans(model.cells, max(1, min(len(model.cells), n // size)), 8, 7)
    group_of = (2 * model.cells @ centre.T - (centre**2).sum(1)).argmax(1).astype(np.int32)
    held = np.zeros(len(centre), np.int64)
    for r in codes.groupBy((F.col("cell") / model.parts).cast("int").alias("c")).count().collect():
        held[group_of[r["c"]]] += r["count"]
    mapped = spark.sparkContext.broadcast(group_of)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, group_of = shipped.value, mapped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, dimension)
            near = model.nearest(x, probes)
            g = group_of[near // model.parts]
            order = np.argsort(g, axis=1, kind="stable")
            near, g = np.take_along_axis(near, order, 1), np.take_along_axis(g, order, 1)
            new = np.ones(g.shape, bool)
            new[:, 1:] = g[:, 1:] != g[:, :-1]
            starts = np.flatnonzero(new.ravel())
            rows = pa.array(starts // g.shape[1])
            lists = pa.ListArray.from_arrays(pa.array([*starts, near.size], pa.int32()), pa.array(near.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(g.ravel()[starts], pa.int32()), lists], ["node", "vec", "g", "cells"])

    asked = codes.select("node", "vec").mapInArrow(groups, "node long, vec binary, g int, cells array<long>")
    # A group's queries are bounded by all vectors; where a group is large, its rows and queries are dealt.
    touched = np.zeros(len(centre))
    near = group_of[model.nearest(x[:ASKED], probes) // model.parts]
    for row in near:
        touched[np.unique(row)] += n / len(near)
    plan = pd.DataFrame({"g": np.arange(len(centre)), "blocks": np.maximum(1, -(-held // BLOCK)), "chunks": np.maximum(1, np.ceil(touched / CHUNK))}).astype({"g": int, "blocks": int, "chunks": int})
    plan = spark.createDataFrame(plan.values.tolist(), "g int, blocks int, chunks int")
    split = lambda by: F.pmod(F.xxhash64("node"), F.col(by)).cast("int")
    counted = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    listed = spark.createDataFrame([(c, int(g)) for c, g in enumerate(group_of)], "c int, g int")
    placed = codes.withColumn("c", (F.col("cell") / model.parts).cast("int")).join(F.broadcast(listed), "c").join(F.broadcast(plan), "g")
    data = placed.select("g", split("blocks").alias("b"), counted("chunks").alias("u"), "cell", "node", "vec", "code", "norm")
    query = asked.join(F.broadcast(plan), "g").select("g", counted("blocks").alias("b"), split("chunks").alias("u"), "node", "vec", "cells")

    def search(key: tuple, data: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(query):
            return pd.DataFrame({"q": [], "node": [], "sim": []})
        return search_unit(shipped.value, data, query, k, dimension)

    pairs = data.groupBy("g", "b", "u").cogroup(query.groupBy("g", "b", "u")).applyInPandas(search, "q long, node long, sim double")
    nearest = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "node"))).filter(F.col("r") <= k + 1).drop("r")
    named = nearest.join(nodes.select("node", F.explode("ids").alias("neighbour")), "node").select(F.col("q").alias("node"), "neighbour", "sim")
    copies = nodes.filter(F.size("ids") > 1).select("node", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("sim"))
    lists = named.unionByName(copies).withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "neighbour"))).filter(F.col("r") <= k + 1).drop("r")
    owners = ids.join(nodes.select(*key, "node"), key).select("id", "node")
    each = owners.join(lists, "node").filter("id <> neighbour").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour"))).filter(F.col("rank") <= k)
    return each.select(F.col("id").alias(item), "neighbour", F.col("sim").alias("cosine"), "rank")

