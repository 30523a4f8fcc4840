"""An index for approximate nearest vectors: cells, product codes of residuals, exact rescoring.

Every vector lies in the list of its nearest centre; a list holds ids and codes: the residual to the centre is cut into
parts, each coded by the nearest of up to 256 codewords. A search reads the lists of the cells nearest to the query only
(they are partitions of the table, so other files aren't opened), scores codes by table look-ups, and computes the exact
inner product of the best `refine` candidates, whose vectors lie in a second table with the same partitions.

What is learnt comes from a bounded sample of SAMPLE_ROWS rows: at most MAX_CELLS centres and 256 codewords a part. Every
row is indexed. Appends are coded with what was learnt and add files; build anew when the data drift.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillet.functions.vectors import dot
from quillet.operators import cells
from quillet.sources.held import held

WORDS = 256
LIST_ROWS, EXACT_ROWS = 4096, 1024
#: Queries that meet the lists, or lists and vectors, in one task; few queries are dealt over so many tasks by cells.
QUERY_ROWS, SEARCH_ROWS, TASKS = 256, 2048, 16
#: So many rows are searched by brute force to choose how much an index has to read.
CALIBRATION = 256
LIST = "cell int, ids array<bigint>, codes binary"
ASKED = "pack bigint, ids array<bigint>, data binary, edges array<double>, cells array<int>"


def split(m: np.ndarray, parts: int) -> np.ndarray:
    """rows x parts x numbers a part; the last part is filled up with zeros."""
    width = -(-m.shape[1] // parts)
    return np.pad(m, ((0, 0), (0, width * parts - m.shape[1]))).reshape(len(m), parts, width)


def codewords(m: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Up to WORDS means of rows, by k-means from rows at even distances."""
    words = np.unique(m, axis=0)
    words = words[np.linspace(0, len(words) - 1, min(WORDS, len(words))).astype(int)]
    for _ in range(rounds):
        near = closest(m, words)
        n = np.bincount(near, minlength=len(words))
        total = np.stack([np.bincount(near, m[:, j], len(words)) for j in range(m.shape[1])], 1)
        words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words)
    return words


def closest(m: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmax(m @ words.T - 0.5 * (words * words).sum(1), 1)


def best(score: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the n largest of each row; of equal ones those with the smallest ids, as rankings have them."""
    edge = np.partition(score, score.shape[1] - n, 1)[:, score.shape[1] - n]
    near = score >= edge[:, None]
    for r in np.flatnonzero(near.sum(1) > n):  # equal rows may be many
        tied = np.flatnonzero(near[r])
        near[r, tied[np.lexsort((ids[tied], -score[r, tied]))[n:]]] = False
    return np.nonzero(near)


def cells_of(q: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The cells nearest to each row of q, best first."""
    return np.argsort(-(q @ centres.T), 1, kind="stable")[:, :probes]


class VectorIndex:
    """The index under path; build() makes one, the constructor opens one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        learnt = {r.what: np.frombuffer(r.data, np.float64).reshape(r.rows, -1) for r in spark.read.parquet(f"{self.path}/learnt").collect()}  # bounded: see the module
        self.centres = learnt.pop("centres")
        self.words = [learnt[f"part-{i:03d}"] for i in range(len(learnt))]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, n_cells: int | None = None, parts: int = 8) -> VectorIndex:
        """Index (id, embedding); null vectors aren't indexed. n_cells: by default about the root of the number of rows."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        v = held(vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding"), "vectors")
        n = v.count()
        centres = cells.learn_centres(cells.sample_of(v, n), n_cells or max(1, round(n**0.5)))
        if not len(centres):
            raise ValueError("an index needs a vector to begin with")
        parts = min(parts, centres.shape[1])
        sample = cells.with_cells(cells.sample_of(v, n), centres)

        def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = cells.matrix_of(batch.column("embedding"))
                s = split(m - centres[batch.column("cell").to_numpy()], parts)
                for i in range(parts):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "width": pa.array([s.shape[2]], pa.int32()), "data": pa.array([s[:, i].tobytes()], pa.binary())})

        kind = pa.schema([("what", pa.string()), ("rows", pa.int32()), ("data", pa.binary())])

        def learn(group: pa.Table) -> pa.Table:
            m = np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in group.column("data")]).reshape(-1, group.column("width")[0].as_py())
            m = m[np.lexsort(m.T)]  # whatever the order that rows came in
            w = codewords(m)
            return pa.Table.from_pydict({"what": [f"part-{group.column('part')[0].as_py():03d}"], "rows": [len(w)], "data": [w.tobytes()]}, schema=kind)

        learnt = sample.mapInArrow(residuals, "part int, width int, data binary").groupBy("part").applyInArrow(learn, "what string, rows int, data binary")
        own = spark.createDataFrame([("centres", len(centres), bytearray(centres.tobytes()))], "what string, rows int, data binary")
        own.unionByName(learnt).write.parquet(f"{path}/learnt")
        index = cls(spark, path)
        index.append(v)
        return index

    def append(self, vectors: DataFrame) -> None:
        """Add rows to the lists; their ids must be new."""
        centres, words, key = self.centres, self.words, ["cell", "id"]
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed = held(cells.with_cells(vectors.select("id", "embedding"), centres), "placed")
        placed = placed.repartitionByRange(n, *key).sortWithinPartitions(*key)
        placed.write.mode("append").partitionBy("cell").parquet(f"{self.path}/exact")

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                cell = whole.column("cell").to_numpy()
                cuts = np.flatnonzero(np.diff(cell)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
                    for s in range(a, b, LIST_ROWS):
                        batch = whole.slice(s, min(LIST_ROWS, b - s))
                        r = split(cells.matrix_of(batch.column("embedding")) - centres[cell[a]], len(words))
                        codes = np.stack([closest(r[:, i], w) for i, w in enumerate(words)], 1).astype(np.uint8)
                        yield pa.RecordBatch.from_pydict({"cell": pa.array([cell[a]], pa.int32()), "ids": pa.array([batch.column("id").to_numpy()], pa.list_(pa.int64())), "codes": pa.array([codes.tobytes()], pa.binary())})

        placed.mapInArrow(code, LIST).write.mode("append").partitionBy("cell").parquet(f"{self.path}/lists")

    def lists(self) -> DataFrame:
        return self.spark.read.schema("ids array<bigint>, codes binary, cell int").parquet(f"{self.path}/lists")

    def exact(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/exact")

    def candidates(self, queries: DataFrame, probes: int, refine: int, only: list[int] | None = None) -> DataFrame:
        """query_id, id, cell, rn (from 1) of the best `refine` rows of each query (id, embedding) by codes. only: the cells that can be probed."""
        asked, packs, parts = self.packed(queries, probes, QUERY_ROWS)
        found = self.met(asked, packs, parts, self.coded(only)).mapInArrow(self.looking(probes, refine, True), "query_id bigint, id bigint, cell int, about double")
        w = Window.partitionBy("query_id").orderBy(F.desc("about"), "id")
        return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= refine).select("query_id", "id", "cell", "rn")

    def coded(self, only: list[int] | None) -> DataFrame:
        """cell, ids, data: the lists, all or of some cells."""
        lists = self.lists().select("cell", "ids", F.col("codes").alias("data"))
        return lists if only is None else lists.where(F.col("cell").isin(only))

    def packed(self, queries: DataFrame, probes: int, size: int) -> tuple[DataFrame, int, int]:
        """ASKED rows, a pack of about `size` queries (id, embedding, perhaps edge) each, with the cells they probe; how many packs, and parts of cells, make the tasks."""
        centres = self.centres
        q = queries.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding", F.col("edge") if "edge" in queries.columns else F.lit(0.0).alias("edge"))
        packs = max(1, -(-q.count() // size))
        parts = max(1, min(TASKS // packs, len(centres)))
        rows = q.groupBy(F.pmod(F.xxhash64("id"), F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct("id", "embedding", "edge")).alias("asked"))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    asked = batch.column("asked")[i].values
                    m = cells.matrix_of(asked.field("embedding"))
                    probed = np.unique(cells_of(m, centres, probes)).astype(np.int32)
                    yield pa.RecordBatch.from_pydict({"pack": [batch.column("pack")[i].as_py()], "ids": pa.array([asked.field("id").to_numpy()], pa.list_(pa.int64())), "data": pa.array([m.tobytes()], pa.binary()), "edges": pa.array([asked.field("edge").to_numpy()], pa.list_(pa.float64())), "cells": pa.array([probed], pa.list_(pa.int32()))})

        return held(rows.mapInArrow(probe, ASKED), "asked"), packs, parts

    def met(self, asked: DataFrame, packs: int, parts: int, *tables: DataFrame) -> DataFrame:
        """pack, part, side, cell, ids, data, edges: each pack (side 0) and after it, cell by cell, the rows of tables (cell, ids, data) that it probes, a part of the cells in a task.

        So what moves is the tables once for each pack, however many cells a query probes.
        """
        of = lambda cell: F.pmod(F.xxhash64(cell), F.lit(parts)).cast("int").alias("part")
        none = F.lit(None).cast("array<double>").alias("edges")
        probed = asked.select("pack", F.explode("cells").alias("cell"))
        all_ = asked.select("pack", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("side"), F.lit(-1).alias("cell"), "ids", "data", "edges")
        for side, t in enumerate(tables, 1):
            all_ = all_.unionByName(t.join(probed, "cell").select("pack", of("cell"), F.lit(side).alias("side"), "cell", "ids", "data", none))
        return all_.repartitionById(packs * parts, (F.col("pack") * parts + F.col("part")).cast("int")).sortWithinPartitions("pack", "part", "cell", "side")

    def scorer(self, probes: int) -> Callable:
        """For a pack's matrix: which of its rows probe a cell, and the scores of these with a list's codes."""
        words, centres = self.words, self.centres

        def of(q: np.ndarray) -> tuple[Callable, Callable]:
            probed = np.zeros((len(q), len(centres)), bool)
            np.put_along_axis(probed, cells_of(q, centres, probes), True, 1)
            tables, near = [x @ w.T for w, x in zip(words, split(q, len(words)).transpose(1, 0, 2), strict=True)], q @ centres.T

            def score(cell: int, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
                out = np.repeat(near[at, cell][:, None], len(codes), 1)
                for j, t in enumerate(tables):
                    out += np.take(t[at], codes[:, j], 1)
                return out

            return (lambda cell: np.flatnonzero(probed[:, cell])), score

        return of

    def looking(self, probes: int, refine: int, rows: bool) -> Callable:
        """Of each query the best `refine` rows of the lists of its task (and more, which later ones surpass); not rows: query_id, edge, the score of the last of them."""
        scorer = self.scorer(probes)
        found = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("cell", pa.int32()), ("about", pa.float64())])
        last = pa.schema([("query_id", pa.int64()), ("edge", pa.float64())])

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qi, held_, fresh, have, edge = None, None, [], 0, None

            def settle() -> None:
                nonlocal held_, fresh, have, edge
                every = np.concatenate([held_, *fresh], 1)
                n = every.shape[1]
                held_ = every if n <= refine else np.partition(every, n - refine, 1)[:, n - refine :]
                edge = np.full(len(qi), -np.inf) if n < refine else held_.min(1)
                fresh, have = [], 0

            def end() -> Iterator[pa.RecordBatch]:
                if qi is not None and not rows:
                    settle()
                    yield pa.RecordBatch.from_arrays([pa.array(qi), pa.array(edge)], schema=last)

            for batch in batches:
                for i in range(batch.num_rows):
                    ids, data = batch.column("ids")[i].values.to_numpy(), batch.column("data")[i].as_buffer()
                    if batch.column("side")[i].as_py() == 0:
                        yield from end()
                        qi = ids.copy()
                        q = np.frombuffer(data, np.float64).reshape(len(ids), -1)
                        (probing, score), held_, fresh, have, edge = scorer(q), np.zeros((len(ids), 0)), [], 0, np.full(len(ids), -np.inf)
                        continue
                    cell, codes = batch.column("cell")[i].as_py(), np.frombuffer(data, np.uint8).reshape(len(ids), -1)
                    at = probing(cell)
                    about = score(cell, codes, at)
                    if rows:
                        row, top = best(about, ids, min(refine, len(ids)))
                        keep = about[row, top] >= edge[at[row]]
                        row, top = row[keep], top[keep]
                        yield pa.RecordBatch.from_arrays([pa.array(qi[at[row]]), pa.array(ids[top]), pa.array(np.full(len(top), cell, np.int32)), pa.array(about[row, top])], schema=found)
                    fresh.append(np.full((len(qi), len(ids)), -np.inf))
                    fresh[-1][at] = about
                    have += len(ids)
                    if have >= max(refine, LIST_ROWS):
                        settle()
            yield from end()

        return look

    def search(self, queries: DataFrame, k: int = 5, probes: int = 8, refine: int = 64, threshold: float = 0.0, only: list[int] | None = None) -> DataFrame:
        """query_id, id, rank (from 0), sim: of each query (id, embedding) the k best of `refine` candidates, by exact products; itself left out.

        Rows that the codes tell no worse than the last candidate are candidates too. These aren't written down: a first
        pass over the lists gives each query's last score, a second one over lists and vectors the products of what reaches it.
        """
        asked, packs, parts = self.packed(queries, probes, QUERY_ROWS)
        if parts == 1:
            edges = self.met(asked, packs, 1, self.coded(only)).mapInArrow(self.looking(probes, refine + 1, False), "query_id bigint, edge double")
        else:  # few queries: their candidates in parts of the cells are few rows
            looked = self.met(asked, packs, parts, self.coded(only)).mapInArrow(self.looking(probes, refine + 1, True), "query_id bigint, id bigint, cell int, about double")
            rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("about"), "id"))
            edges = looked.withColumn("rn", rn).where(F.col("rn") <= refine + 1).groupBy("query_id").agg(F.when(F.count("*") > refine, F.min("about")).otherwise(-float("inf")).alias("edge"))
        q = queries.select(F.col("id").cast("long").alias("id"), "embedding").join(held(edges, "edges").withColumnRenamed("query_id", "id"), "id")
        asked, packs, parts = self.packed(q, probes, SEARCH_ROWS)
        kind = dict(self.exact().dtypes)["embedding"]
        number, scorer, n_words = np.float32 if kind == "array<float>" else np.float64, self.scorer(probes), len(self.words)

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                cell = whole.column("cell").to_numpy()
                cuts = np.flatnonzero(np.diff(cell)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
                    for s in range(a, b, EXACT_ROWS):
                        batch = whole.slice(s, min(EXACT_ROWS, b - s))
                        yield pa.RecordBatch.from_pydict({"cell": pa.array([cell[a]], pa.int32()), "ids": pa.array([batch.column("id").to_numpy()], pa.list_(pa.int64())), "data": pa.array([cells.matrix_of(batch.column("embedding")).astype(number).tobytes()], pa.binary())})

        rows = self.exact() if only is None else self.exact().where(F.col("cell").isin(only))
        exact = rows.select("cell", "id", "embedding").mapInArrow(lists, "cell int, ids array<bigint>, data binary")

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from quillet.operators.similarity import best_of

            qi, now, top = None, None, best_of(k)

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_pydict({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64()), "sim": pa.array(found[2], pa.float64())})

            for batch in batches:
                for i in range(batch.num_rows):
                    side, cell = batch.column("side")[i].as_py(), batch.column("cell")[i].as_py()
                    ids, data = batch.column("ids")[i].values.to_numpy(), batch.column("data")[i].as_buffer()
                    if side == 0:
                        if qi is not None:
                            yield out()
                        qi, q, edge, now = ids.copy(), np.frombuffer(data, np.float64).reshape(len(ids), -1).copy(), batch.column("edges")[i].values.to_numpy().copy(), None
                        (probing, score), found, least = scorer(q), (qi[:0], qi[:0], np.zeros(0)), np.full(len(qi), -np.inf)
                        continue
                    if cell != now:
                        now, listed, codes = cell, ids[:0], np.zeros((0, n_words), np.uint8)
                    if side == 1:  # the cell's codes come before its vectors
                        listed, codes = np.concatenate([listed, ids]), np.concatenate([codes, np.frombuffer(data, np.uint8).reshape(len(ids), -1)])
                        order = np.argsort(listed)
                        listed, codes = listed[order], codes[order]
                        continue
                    at, m = probing(cell), np.frombuffer(data, number).reshape(len(ids), -1).astype(np.float64)
                    about = score(cell, codes[np.searchsorted(listed, ids)], at)
                    sim = q[at] @ m.T
                    row, col = np.nonzero((about >= edge[at, None] - cells.SLACK) & (sim >= least[at, None] - cells.SLACK - 1e-6) & (qi[at, None] != ids))
                    if len(row):
                        found = top.merge(*(np.concatenate(x) for x in zip(found, (qi[at[row]], ids[col], sim[row, col]), strict=True)))
                        least = top.reached(qi, found, least)
            if qi is not None:
                yield out()

        scored = self.met(asked, packs, parts, self.coded(only), exact).mapInArrow(near, "a bigint, b bigint, sim double")
        w = Window.partitionBy("a").orderBy(F.desc(F.round("sim", 6)), "b")
        top = scored.withColumn("rn", F.row_number().over(w)).where((F.col("rn") <= k) & (F.col("sim") >= threshold))
        return top.select(F.col("a").alias("query_id"), F.col("b").alias("id"), (F.col("rn") - 1).alias("rank"), "sim")

    def calibrated(self, vectors: DataFrame, k: int = 5, probes: int = 8, refine: int = 64, recall: float = 0.95) -> tuple[int, int]:
        """probes and refine, raised as far as it takes to find `recall` of the k nearest rows of CALIBRATION indexed rows.

        Their neighbours are found by brute force; half of what may be missed is left to cells that aren't probed, and the
        places of the others in the order by codes tell how many candidates need exact products.
        """
        from quillet.operators.similarity import knn

        v = vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding")
        rows = v.count()
        asked = held(v.orderBy(F.xxhash64("id", F.lit("calibrate")), "id").limit(CALIBRATION), "asked")
        true = held(knn(asked, v, k, -np.inf).select("query_id", "id"), "true")
        found = true.join(self.exact().select("id", "cell"), "id").join(asked.select(F.col("id").alias("query_id"), "embedding"), "query_id").select("cell", "embedding").toArrow()  # CALIBRATION * k rows
        if not found.num_rows:
            return probes, refine
        matrix = cells.matrix_of(found.column("embedding").combine_chunks())
        order = cells_of(matrix, self.centres, len(self.centres))
        place = np.sort(np.argmax(order == found.column("cell").to_numpy()[:, None], 1)) + 1
        probes = max(min(probes, len(self.centres)), int(place[int(np.ceil((1 + recall) / 2 * len(matrix))) - 1]))
        need, reach = int(np.ceil(recall * len(matrix))), 16 * refine
        while True:
            near = self.candidates(asked, probes, reach + 1).where("query_id <> id")
            at = sorted(r.rn for r in near.join(true, ["query_id", "id"], "left_semi").select("rn").collect())  # CALIBRATION * k rows
            if len(at) >= need or reach >= rows:
                return probes, max(refine, at[min(need, len(at)) - 1]) if at else reach
            reach *= 16

    def first(self, vector: list[float], retrieve_k: int, probes: int = 8) -> Callable[[DataFrame], DataFrame]:
        """For similarity.rerank: the candidates' rows of a table (id, embedding), found by codes in the probed cells' files alone."""
        only = cells_of(np.asarray([vector], np.float64), self.centres, probes)[0].tolist()
        asked = self.spark.createDataFrame([(-1, [float(x) for x in vector])], "id bigint, embedding array<double>")
        near = self.candidates(asked, probes, retrieve_k, only).select("cell", "id")
        rows = self.exact().where(F.col("cell").isin(only)).join(near, ["cell", "id"], "left_semi").select("id", "embedding")
        return lambda table: rows

    def topk(self, vector: list[float], k: int = 5, threshold: float = 0.3, retrieve_k: int = 64, probes: int = 8) -> DataFrame:
        """id, similarity (4 decimals): similarity.topk by the index."""
        from quillet.operators.similarity import rerank

        return rerank(self.exact(), vector, k, retrieve_k, threshold, self.first(vector, retrieve_k, probes))

    def share(self, queries: DataFrame, probes: int) -> float:
        """Which share of the indexed rows the searches of queries read, on average."""
        centres = self.centres
        size = self.lists().groupBy("cell").agg(F.sum(F.size("ids")).alias("n"))
        probed = queries.where("embedding is not null").select("embedding").mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"cell": pa.array(cells_of(cells.matrix_of(b.column("embedding")), centres, probes).ravel(), pa.int32())}) for b in bs if b.num_rows), "cell int")
        read = probed.join(size, "cell").agg(F.sum("n")).first()[0] or 0
        return read / max(1, queries.count() * (size.agg(F.sum("n")).first()[0] or 0))
