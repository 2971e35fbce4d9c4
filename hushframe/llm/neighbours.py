"""Approximate nearest neighbours: inverted file, product-quantised residuals, asymmetric tables, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.shared import joined, staged

#: Vectors that the index is fitted on, at most, and bytes of them; coarse cells, at most.
SAMPLE, SAMPLE_BYTES = 60_000, 64 << 20
CELLS = 16_384
#: Dimensions of a quantised part, and codes of a part.
PART, CODES = 4, 256
#: Distinct vectors of a cell that one task looks at.
BLOCK = 4_096
#: Queries that are compared with every row, and the share of their true neighbours that the probed cells must hold.
TRIED, REACH = 128, 0.98


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
        if (~full).any():
            centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[k : k + 4096] @ centres.T - half, 1) for k in range(0, len(x), 4096)] or [np.zeros(0, int)])


class Index:
    """Coarse centroids, and codebooks of the residuals' parts."""

    def __init__(self, sample: np.ndarray, rows: int):
        cells = int(min(CELLS, max(1, round(rows**0.5)), max(1, len(sample) // 8)))
        self.centres = k_means(sample, cells)
        cell = nearest(sample, self.centres)
        rest = sample - self.centres[cell]
        self.cuts = list(range(0, sample.shape[1], PART))
        self.books = [k_means(rest[:, c : c + PART], min(CODES, len(sample))) for c in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes, and the lengths of what the codes leave out."""
        cell = nearest(x, self.centres)
        rest = x - self.centres[cell]
        codes = np.stack([nearest(rest[:, c : c + PART], b).astype(np.uint8) for c, b in zip(self.cuts, self.books)], 1)
        for j, (c, book) in enumerate(zip(self.cuts, self.books)):
            rest[:, c : c + PART] -= book[codes[:, j]]
        return cell, codes, np.sqrt((rest**2).sum(1))

    def ordered_cells(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")

    def approximate(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with a cell's coded vectors, from one table of a query and part each."""
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), 1)
        for j, (c, book) in enumerate(zip(self.cuts, self.books)):
            out += (q[:, c : c + PART] @ book.T)[:, codes[:, j]]
        return out

    def probes(self, q: np.ndarray, which: np.ndarray, cells: np.ndarray) -> int:
        """Cells to probe so that REACH of the given true neighbours are in them: their queries by place in q, and cells."""
        order = self.ordered_cells(q)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
        return int(np.quantile(place[which, cells], REACH, method="higher")) + 1 if len(which) else 1


def leading(rough: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """Which entries may be among a query's k best: what it is at most must reach what k others are at least.

    rough: approximate inner products by query and entry; off: by how much they may be off.
    """
    if rough.shape[1] <= k:
        return np.ones(rough.shape, bool)
    return rough + off >= np.partition(rough - off, -k, axis=1)[:, -k][:, None]


def true_neighbours(coded: DataFrame, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """By comparison with every entry: for each of the k best rows of each query its place in q, and its cell."""
    shared = coded.sparkSession.sparkContext.broadcast(q)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        scores, cells, n = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int32), np.zeros((len(q), 0), np.int32)
        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.iloc[at : at + 4096]
                new = q @ np.array(part["v"].tolist(), np.float64).T
                wide = lambda c: np.broadcast_to(c.to_numpy(np.int32), new.shape)
                scores, cells, n = (np.hstack(p) for p in ((scores, new), (cells, wide(part["cell"])), (n, wide(part["n"]))))
                if scores.shape[1] > k:
                    keep = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                    scores, cells, n = (np.take_along_axis(p, keep, 1) for p in (scores, cells, n))
        if scores.size:
            which = np.repeat(np.arange(len(q), dtype=np.int32), scores.shape[1])
            yield pd.DataFrame({"which": which, "score": scores.ravel(), "cell": cells.ravel(), "n": n.ravel()})

    found = coded.select("v", "cell", F.size("ids").alias("n")).mapInPandas(best, "which int, score double, cell int, n int")
    order = Window.partitionBy("which").orderBy(F.desc("score"), "cell", "n")
    # Entries until they hold k rows, at most k of each query.
    top = found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = top.withColumn("_n", F.least("n", F.lit(k) - before)).where("_n > 0").select("which", "cell", "_n").collect()
    times = [r["_n"] for r in rows]
    return np.repeat(np.array([r["which"] for r in rows], int), times), np.repeat(np.array([r["cell"] for r in rows], int), times)


def _valid(v: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


def _key(v: Column) -> Column:
    """128 bits that tell distinct vectors apart."""
    return F.concat(F.hex(F.xxhash64(v)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), v)))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            yield pd.DataFrame({"x": [np.array(b["v"].tolist(), np.float64).tobytes()]})


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """For each row whose vec_id is divisible by ``every`` the k rows of largest inner product, its own row left out.

    Columns: query_id, rank (from 1), vec_id, score (in double precision, on the original vectors); ties go to the
    smaller vec_id. The index is fitted on at most ``sample`` vectors (by a hash, and within SAMPLE_BYTES) and holds
    all of them. Equal vectors are one entry with their k + 1 smallest vec_ids, more of which no answer can have, so
    that a vector of very many rows costs what any other does. Cells are searched in blocks of bounded size. How many
    are probed is measured: TRIED of the queries are compared with every row, so that neither rows that the sample
    lacks nor queries unlike other rows are missed. Within a cell none is lost: codes leave out only what they show to
    be too far, by the length of what they round off. Probing goes on beyond the usual number of cells until they hold
    k + 1 rows, so that none is missing where there are enough.

    Vectors that are null, zero, or hold null or non-finite components, rows without a vec_id, and vectors whose
    length is not the most frequent one take no part, as query or answer. Rows that repeat a vec_id, with the same
    vector or another, are rows of their own: each is a query, and only the query's own row is no answer to it, so
    that its repeats are. An empty table gives no rows; further columns are ignored.
    """
    own = vectors.where(F.col("vec_id").isNotNull() & _valid(F.col("embedding"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")
    )
    sizes = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head(1)
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], out)
    d = sizes[0]["d"]
    # -0.0 and 0.0 are one number, so that equal vectors have one key.
    own = own.where(F.size("v") == d).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    own = own.withColumn("uid", _key(F.col("v")))
    least = Window.partitionBy("uid").orderBy("vec_id")
    distinct = (
        own.withColumn("n", F.row_number().over(least))
        .where(F.col("n") <= k + 1)
        .groupBy("uid")
        .agg(F.any_value("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    distinct = staged(distinct, "ann-distinct")
    n = distinct.count()
    sample = max(1, min(sample, SAMPLE_BYTES // (8 * d)))
    chance = F.shiftrightunsigned(F.xxhash64("uid", F.lit(9)), 11) / F.lit(float(2**53))
    picked = distinct.where(chance < min(1.0, 0.95 * sample / n)).select("v").limit(sample) if n > sample else distinct.select("v")
    blobs = picked.mapInPandas(_packed, "x binary").collect()
    points = np.concatenate([np.frombuffer(r["x"], np.float64).reshape(-1, d) for r in blobs])
    index = Index(points[np.lexsort(points.T)], n)
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cell, codes, off = shared.value.encode(np.array(b["v"].tolist(), np.float64))
                yield b.assign(cell=cell.astype(np.int32), codes=[c.tobytes() for c in codes], off=off)

    coded = staged(
        distinct.mapInPandas(encode, "uid string, v array<double>, ids array<long>, cell int, codes binary, off double"), "ann-coded"
    )
    asked = own.where(F.col("vec_id") % every == 0).select("vec_id", "uid", F.monotonically_increasing_id().alias("row"))
    asked = staged(asked, "ann-queries")
    times = staged(asked.groupBy("uid").agg(F.count("*").alias("n")), "ann-times")
    tried = distinct.join(times, "uid", "left_semi").orderBy(F.xxhash64("uid", F.lit(10)), "uid").select("v").limit(TRIED).collect()
    q = np.array([r["v"] for r in tried], np.float64).reshape(-1, d)
    usual = index.probes(q, *true_neighbours(coded, q, k + 1))
    held = np.zeros(len(index.centres), np.int64)
    entries = np.zeros(len(index.centres), np.int64)
    # A row for each cell.
    for r in coded.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect():
        entries[r["cell"]], held[r["cell"]] = r["n"], r["ids"]
    blocks = np.maximum(1, -(-entries // BLOCK))
    plan = vectors.sparkSession.sparkContext.broadcast((held, blocks, entries, usual))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, blocks, entries, usual = plan.value
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                order = shared.value.ordered_cells(np.array(part["v"].tolist(), np.float64))
                needed = np.maximum((np.cumsum(held[order], 1) < k + 1).sum(1) + 1, usual)
                who, where, which = [], [], []
                for i, cells in enumerate(order):
                    for c in cells[: needed[i]]:
                        if entries[c]:
                            who += [i] * int(blocks[c])
                            where += [int(c)] * int(blocks[c])
                            which += range(int(blocks[c]))
                yield pd.DataFrame({"cell": where, "block": which, "qid": part["uid"].to_numpy()[who], "q": [part["v"].iloc[i] for i in who]})

    probes = distinct.join(times, "uid", "left_semi").mapInPandas(probe, "cell int, block int, qid string, q array<double>")
    spread = F.array(*map(F.lit, blocks.tolist())) if len(blocks) <= 512 else None
    if spread is None:
        table = vectors.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(blocks)], "cell int, nb int")
        placed = coded.join(F.broadcast(table), "cell")
    else:
        placed = coded.withColumn("nb", F.element_at(spread, F.col("cell") + 1))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("uid"), F.col("nb")).cast("int")).drop("nb")

    def search(key: tuple, entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"qid": np.zeros(0, object), "uid": np.zeros(0, object), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(entries) or not len(queries):
            return none
        index = shared.value
        entries = entries.sort_values("ids", key=lambda ids: ids.map(lambda x: x[0]))
        x = np.array(entries["v"].tolist(), np.float64)
        codes = np.frombuffer(b"".join(entries["codes"]), np.uint8).reshape(len(x), -1)
        off = entries["off"].to_numpy()
        ids, uids = entries["ids"].tolist(), entries["uid"].tolist()
        found = []
        for at in range(0, len(queries), 128):
            q = np.array(queries["q"].iloc[at : at + 128].tolist(), np.float64)
            names = queries["qid"].to_numpy()[at : at + 128]
            # Rounding is within a part in 10^9 of the factors' lengths.
            most = np.sqrt((q**2).sum(1))[:, None] * (off + 1e-9 * np.sqrt((x**2).sum(1)))
            may = leading(index.approximate(q, int(key[0]), codes), most, k + 1)
            at_all = np.flatnonzero(may.any(0))
            exact = np.where(may[:, at_all], q @ x[at_all].T, -np.inf)
            least = np.partition(exact, -(k + 1), axis=1)[:, -(k + 1)] if exact.shape[1] > k + 1 else np.full(len(q), -np.inf)
            for i, name in enumerate(names):
                # Entries come by their smallest vec_id; those level with the last but for rounding are looked at too.
                near = at_all[(exact[i] > -np.inf) & (exact[i] >= least[i] - 1e-9 * abs(least[i]))]
                scores = (x[near] * q[i]).sum(1)
                best = np.argsort(-scores, kind="stable")[: k + 1]
                flat = [(-s, v, uids[e]) for s, e in zip(scores[best].tolist(), near[best]) for v in ids[e]]
                found += [(name, u, v, -s) for s, v, u in sorted(flat)[: k + 1]]
        return pd.DataFrame(found, columns=["qid", "uid", "vec_id", "score"]) if found else none

    answers = (
        placed.groupBy("cell", "block")
        .cogroup(probes.groupBy("cell", "block"))
        .applyInPandas(search, "qid string, uid string, vec_id long, score double")
    )
    top = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "uid")
    lists = (
        answers.withColumn("place", F.row_number().over(top))
        .where(F.col("place") <= k + 1)
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("place", "uid", "vec_id", "score"))).alias("best"))
    )
    lists = staged(lists.withColumnRenamed("qid", "uid").join(times, "uid"), "ann-lists")
    # One of the rows that are like the query's own is that row; it may be beyond the list, which is then long enough.
    same = F.transform("best", lambda x: (x["vec_id"] == F.col("query_id")) & (x["uid"] == F.col("uid")))
    own_place = F.array_position(same, True)
    others = F.slice(F.filter("best", lambda x: x["place"] != F.col("own")), 1, k)
    return (
        joined(asked.withColumnRenamed("vec_id", "query_id"), lists, ["uid"], "row")
        .withColumn("own", own_place)
        .select("query_id", F.posexplode(others).alias("p", "x"))
        .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
    )
