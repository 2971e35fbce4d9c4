"""Ranked lexical search: documents reordered by recursive graph bisection, a clustered index, visits by bound."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.decontaminate import words_of
from hushframe.llm.shared import staged

#: UTF-8 bytes of queries that are searched for at once; their terms are one dictionary in a broadcast. More queries
#: are searched for in as many passes as they need.
BLOCK_BYTES = 1 << 20
#: Documents on which the bisection is fitted, and documents that a cluster should hold; no more than 2**DEPTH clusters.
SAMPLE, CLUSTER, DEPTH = 4096, 64, 8
#: Rounds of swaps at one bisection.
SWAPS = 12
#: Documents and postings of a shard of the index.
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 21
#: Shards that a query visits in the first rounds; the last round visits all that may still hold a better document.
ROUNDS = (4, 32)


class Queries:
    """Queries in arrays: their terms by number, and for each the numbers of its terms and how often it repeats them."""

    def __init__(self, texts: list[str | None]):
        self.number: dict[bytes, int] = {}
        self.terms, self.times = [], []
        for text in texts:
            found = sorted((self.number.setdefault(w, len(self.number)), n) for w, n in Counter(words_of(text)).items())
            self.terms.append(np.array([t for t, _ in found], np.int64))
            self.times.append(np.array([n for _, n in found], np.int64))

    def weigh(self, weight: np.ndarray) -> None:
        """weight: by term. Afterwards weights has for each query what a unit of impact of each of its terms is worth."""
        self.weights = [weight[t] * n for t, n in zip(self.terms, self.times)]

    def bounds(self, terms: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """By query the most that a document can score in which no term has more than its top."""
        most = np.zeros(len(self.number) + 1, np.int64)
        most[terms] = tops
        return np.array([int((most[t] * w).sum()) for t, w in zip(self.terms, self.weights)], np.int64)


def counted(docs: DataFrame, queries: Queries) -> DataFrame:
    """doc_id, n (terms, with repeats), and terms and times of those terms that queries hold; documents without a term
    are left out."""
    known = docs.sparkSession.sparkContext.broadcast(queries.number)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = known.value.get
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                words = words_of(text)
                if words:
                    ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
                    terms, times = np.unique(ids[ids >= 0], return_counts=True)
                    rows.append((None if pd.isna(doc) else int(doc), len(words), terms, times))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "terms", "times"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(count, "doc_id long, n long, terms array<int>, times array<long>")


def bisected(docs: list[np.ndarray], n_terms: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Recursive graph bisection of documents (arrays of terms), as a tree that sorts any document.

    A set of documents is parted into halves so that the logarithms of the gaps between the documents of each term
    add up to least: documents swap sides as long as pairs of them gain by it. What a term then gains on the right over
    the left, added up over a document's terms, sends a document right if it is above the median of the set.
    Returns by node (children of k: 2k + 1, 2k + 2) the gains of all terms, and the medians.
    """
    nodes = (1 << depth) - 1
    gains, cuts = np.zeros((nodes, n_terms), np.float32), np.full(nodes, np.inf)
    sizes = np.array([len(d) for d in docs], np.int64)
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(docs)), sizes)

    def cost(degree: np.ndarray, size: int) -> np.ndarray:
        degree = np.maximum(degree, 0)
        return degree * np.log2(max(size, 1) / (degree + 1.0))

    sets = {0: np.arange(len(docs))}
    for node in range(nodes):
        own = sets.pop(node, np.zeros(0, np.int64))
        if len(own) < 4:
            continue
        within = np.full(len(docs), -1)
        within[own] = np.arange(len(own))
        at = within[owner]
        terms, at = flat[at >= 0], at[at >= 0]
        # To begin with, documents are parted by the mean of their terms' numbers.
        mean = np.bincount(at, terms, len(own)) / np.maximum(1, np.bincount(at, minlength=len(own)))
        right = np.zeros(len(own), bool)
        right[np.argsort(mean, kind="stable")[len(own) // 2 :]] = True
        for _ in range(SWAPS):
            n1, n2 = int((~right).sum()), int(right.sum())
            d1, d2 = (np.bincount(terms[right[at] == side], minlength=n_terms) for side in (False, True))
            now = cost(d1, n1) + cost(d2, n2)
            to_right, to_left = now - cost(d1 - 1, n1) - cost(d2 + 1, n2), now - cost(d1 + 1, n1) - cost(d2 - 1, n2)
            gain = np.bincount(at, np.where(right[at], to_left[terms], to_right[terms]), len(own))
            a, b = np.flatnonzero(~right), np.flatnonzero(right)
            a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
            k = min(len(a), len(b))
            swap = gain[a[:k]] + gain[b[:k]] > 1e-9
            if not swap.any():
                break
            right[a[:k][swap]], right[b[:k][swap]] = True, False
        d1, d2 = (np.bincount(terms[right[at] == side], minlength=n_terms) for side in (False, True))
        n1, n2 = int((~right).sum()), int(right.sum())
        gains[node] = (cost(d1 + 1, n1) - cost(d1, n1)) - (cost(d2 + 1, n2) - cost(d2, n2))
        score = np.bincount(at, gains[node][terms], len(own))
        cuts[node] = np.sort(score)[(len(own) - 1) // 2]
        side = score > cuts[node]
        sets[2 * node + 1], sets[2 * node + 2] = own[~side], own[side]
    return gains, cuts


def sorted_down(gains: np.ndarray, cuts: np.ndarray, flat: np.ndarray, owner: np.ndarray, n: int, depth: int) -> np.ndarray:
    """The cluster of each of n documents, in the order of the bisection; flat: terms, owner: their documents."""
    node = np.zeros(n, np.int64)
    for _ in range(depth):
        score = np.bincount(owner, gains[node[owner], flat], n)
        node = 2 * node + 1 + (score > cuts[node])
    return node - ((1 << depth) - 1)


INDEX = "cluster int, shard long, n int, ids binary, absent binary, terms binary, starts binary, docs binary, impacts binary, tops binary"


def _packed(cluster: int, shard: int, ids: list, terms: list[np.ndarray], impacts: list[np.ndarray]) -> tuple:
    """A shard as a row: documents, and for each term its documents (their places in the shard), impacts and top impact."""
    sizes = [len(t) for t in terms]
    flat, impact = np.concatenate(terms), np.concatenate(impacts)
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    order = np.argsort(flat, kind="stable")
    flat, impact, owner = flat[order], impact[order], owner[order]
    own, starts = np.unique(flat, return_index=True)
    tops = np.maximum.reduceat(impact, starts) if len(starts) else np.zeros(0, np.int64)
    absent = np.array([i is None for i in ids], bool)
    known = np.array([0 if i is None else i for i in ids], np.int64)
    return (
        cluster, shard, len(ids), known.tobytes(), absent.tobytes(), own.astype(np.int32).tobytes(), np.append(starts, len(flat)).astype(np.int64).tobytes(),
        owner.tobytes(), impact.astype(np.int32).tobytes(), tops.astype(np.int64).tobytes(),
    )


def clustered_index(counts: DataFrame, n_docs: int, n_words: int, tree: tuple[np.ndarray, np.ndarray], depth: int) -> DataFrame:
    """The postings of ``counted`` in shards, a row for each, that hold documents of one cluster only, in the order
    of clusters in each file. An impact is (10**9 tf) div (1000 tf + 12 m), with m = 75 + (25 n N) div L."""
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast(tree)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gains, cuts = shared.value
        for b in batches:
            if not len(b):
                continue
            sizes = b["terms"].map(len).to_numpy(np.int64)
            flat = np.concatenate([np.asarray(t, np.int64) for t in b["terms"]])
            tf = np.concatenate([np.asarray(t, np.int64) for t in b["times"]])
            owner = np.repeat(np.arange(len(b)), sizes)
            m = 75 + (25 * b["n"].to_numpy(np.int64) * n_docs) // n_words
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[owner])
            ends = np.cumsum(sizes)[:-1]
            yield pd.DataFrame({
                "cluster": sorted_down(gains, cuts, flat, owner, len(b), depth).astype(np.int32),
                "doc_id": b["doc_id"], "terms": b["terms"], "impacts": np.split(impact.astype(np.int32), ends),
            })

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, postings = TaskContext.get().partitionId() << 32, 0
        cluster, ids, terms, impacts = None, [], [], []
        for b in batches:
            out = []
            for c, doc, t, i in zip(b["cluster"], b["doc_id"], b["terms"], b["impacts"]):
                if ids and (c != cluster or len(ids) >= SHARD_DOCS or postings + len(t) > SHARD_POSTINGS):
                    out.append(_packed(cluster, shard, ids, terms, impacts))
                    shard, postings, ids, terms, impacts = shard + 1, 0, [], [], []
                cluster, postings = c, postings + len(t)
                ids.append(None if pd.isna(doc) else int(doc))
                terms.append(np.asarray(t, np.int32))
                impacts.append(np.asarray(i, np.int64))
            if out:
                yield pd.DataFrame(out, columns=names)
        if ids:
            yield pd.DataFrame([_packed(cluster, shard, ids, terms, impacts)], columns=names)

    names = [c.split()[0] for c in INDEX.split(", ")]
    rows = counts.where("size(terms) > 0").mapInPandas(placed, "cluster int, doc_id long, terms array<int>, impacts array<int>")
    # However many documents fall into one cluster, its parts are of the same size.
    part = F.pmod(F.xxhash64("doc_id", "impacts"), F.lit(-(-n_docs // (1 << 16))))
    rows = rows.withColumn("part", part).repartition("cluster", "part").sortWithinPartitions("cluster", "doc_id")
    return staged(rows.drop("part").mapInPandas(packed, INDEX), "search-index")


def _unpacked(row) -> tuple[np.ndarray, ...]:
    kinds = {"ids": np.int64, "absent": bool, "terms": np.int32, "starts": np.int64, "docs": np.int32, "impacts": np.int32}
    return tuple(np.frombuffer(getattr(row, k), kind) for k, kind in kinds.items())


def promising(index: DataFrame, queries, floor: np.ndarray, seen: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """By query up to ``most`` shards (cluster, shard, query) of the highest bounds that are not under the query's floor
    and that it has not seen (pairs of shard and query)."""
    sc = index.sparkSession.sparkContext
    given = sc.broadcast((floor, {tuple(p) for p in seen.tolist()}))

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least, gone = given.value
        q, best = queries.value, {}
        for b in batches:
            for cluster, shard, terms, tops in zip(b["cluster"], b["shard"], b["terms"], b["tops"]):
                bound = q.bounds(np.frombuffer(terms, np.int32), np.frombuffer(tops, np.int64))
                for k in np.flatnonzero((bound >= least) & (bound > 0)).tolist():
                    if (shard, k) not in gone:
                        best.setdefault(k, []).append((-int(bound[k]), int(cluster), int(shard)))
                        if len(best[k]) > 4 * most:
                            best[k] = sorted(best[k])[:most]
        rows = [(k, -x[0], x[1], x[2]) for k, found in best.items() for x in sorted(found)[:most]]
        yield pd.DataFrame(rows, columns=["query", "bound", "cluster", "shard"])

    found = index.select("cluster", "shard", "terms", "tops").mapInPandas(bounds, "query int, bound long, cluster int, shard long")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "cluster", "shard")
    top = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    return [(r["cluster"], r["shard"], r["query"]) for r in top.collect()]


FOUND = "query int, doc_id long, score long"


def scored(index: DataFrame, queries, floor: np.ndarray, seen: np.ndarray, chosen: np.ndarray | None, top: int) -> DataFrame:
    """The best ``top`` documents of each shard for the queries that visit it: those of chosen (pairs of shard and
    query), or without it all that have not seen it and whose bound for it is not under their floor."""
    given = index.sparkSession.sparkContext.broadcast((floor, seen, chosen))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least, gone, wanted = given.value
        q, visits = queries.value, {}
        for shard, k in (gone if wanted is None else wanted).tolist():
            visits.setdefault(shard, set()).add(k)
        for b in batches:
            rows = []
            for row in b.itertuples():
                ids, absent, terms, starts, docs, impacts = _unpacked(row)
                own = visits.get(row.shard, set())
                if wanted is None:
                    bound = q.bounds(terms, np.frombuffer(row.tops, np.int64))
                    own = set(np.flatnonzero((bound >= least) & (bound > 0)).tolist()) - own
                place = np.full(len(q.number) + 1, -1, np.int64)
                place[terms] = np.arange(len(terms))
                for k in sorted(own):
                    total = np.zeros(row.n, np.int64)
                    for at, weight in zip(place[q.terms[k]].tolist(), q.weights[k].tolist()):
                        if at >= 0 and weight:
                            span = slice(starts[at], starts[at + 1])
                            total[docs[span]] += weight * impacts[span].astype(np.int64)
                    need = max(1, int(least[k]))
                    if (total >= need).sum() > top:
                        need = max(need, int(np.partition(total, -top)[-top]))
                    hits = np.flatnonzero(total >= need)
                    hits = hits[np.lexsort((ids[hits], absent[hits], -total[hits]))][:top]
                    rows += [(k, None if absent[h] else int(ids[h]), int(total[h])) for h in hits.tolist()]
            yield pd.DataFrame(rows, columns=["query", "doc_id", "score"]).astype({"doc_id": "Int64"})

    if chosen is not None:
        # Pairs are few: so many for each query of the block.
        clusters = index.where(F.col("cluster").isin(sorted({int(c) for c in chosen[:, 2]})))
        index, given = clusters, index.sparkSession.sparkContext.broadcast((floor, seen, chosen[:, :2]))
    return index.mapInPandas(score, FOUND)


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _searched(docs: DataFrame, items: DataFrame, top: int) -> DataFrame:
    spark = docs.sparkSession
    asked = items.collect()  # within BLOCK_BYTES
    queries = Queries([r["text"] for r in asked])
    result = "item_id {}, rank int, doc_id long, score long".format(items.schema["item_id"].dataType.simpleString())
    if not queries.number:
        return spark.createDataFrame([], result)
    counts = staged(counted(docs, queries), "search-counts")
    total = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    if not total["n"]:
        return spark.createDataFrame([], result)
    n_terms = len(queries.number)
    df = np.zeros(n_terms, np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    queries.weigh(np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * int(d) + 1))) for d in df], np.int64))

    depth = min(DEPTH, max(0, int(math.log2(max(1, total["n"] / CLUSTER)))))
    pick = F.pmod(F.xxhash64("terms", "times"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / total["n"])))
    sample = counts.where("size(terms) > 0").where(pick).select("terms").distinct() if depth else counts.select("terms").limit(0)
    chosen = sorted((r["terms"] for r in sample.limit(2 * SAMPLE).collect()), key=lambda t: (len(t), t))
    tree = bisected([np.array(t, np.int64) for t in chosen], n_terms, depth)
    index = clustered_index(counts, total["n"], total["l"], tree, depth)

    shared = spark.sparkContext.broadcast(queries)
    floor, seen, best = np.ones(len(asked), np.int64), np.zeros((0, 2), np.int64), None
    for most in (*ROUNDS, None):
        pairs = None
        if most:
            pairs = np.array([(s, k, c) for c, s, k in promising(index, shared, floor, seen, most)], np.int64).reshape(-1, 3)
            if not len(pairs):
                break
        found = scored(index, shared, floor, seen, pairs, top)
        best = staged(_best(found if best is None else best.select("query", "doc_id", "score").unionByName(found), top), "search-best")
        if most:
            seen = np.concatenate([seen, pairs[:, :2]])
            ends = best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect()
            for r in ends:
                if r["n"] == top:
                    floor[r["query"]] = r["least"]
    if best is None:
        return spark.createDataFrame([], result)
    names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(asked)], f"query int, {result.split(', ')[0]}")
    return best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """Returns item_id, rank (int, from 1), doc_id and score: for each row of items (item_id, text) the ``top`` documents
    of the highest score above 0, equal scores by doc_id (null last).

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. With N documents that have a term, L
    terms of them all and n of one, df documents with a term and tf its occurrences: w = floor(1000 ln((2N + 2) / (2df +
    1))), m = 75 + (25 n N) div L, and the score adds w ((10**9 tf) div (1000 tf + 12 m)) over the query's terms, repeats
    included.

    A bisection tree fitted on about SAMPLE different documents sorts every document into a cluster; clusters are stored
    in shards with the top impact of each term. A query visits shards by falling bound (what its terms' tops add up to),
    ROUNDS of them at first, and then all whose bound is not under the score of the last document found so far: the
    rest can't hold a better one. The order inside the index never shows: ties go by doc_id.

    Null or empty texts have no terms and are not found; rows that repeat a document are found as often; an item without
    known terms gives no rows, and one that repeats is answered as often; empty tables give no rows; other columns are
    ignored. A query's text stays whole: one above BLOCK_BYTES makes a block of its own size.
    """
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-max(size, 1) // BLOCK_BYTES)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    parts = [_searched(docs, items.select("item_id", "text").where(part == k), top) for k in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SQL = r"""
    WITH d AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ws FROM documents WHERE text IS NOT NULL),
    s AS (SELECT count(*) n, sum(len(ws)) l FROM d WHERE len(ws) > 0),
    q AS (SELECT rid, item_id, w, count(*) times FROM (SELECT row_number() OVER () rid, item_id, unnest(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) w FROM benchmark) GROUP BY ALL),
    p AS (SELECT rid, w, count(*) tf FROM (SELECT rid, unnest(ws) w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY ALL),
    t AS (SELECT w, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) weight FROM p, s GROUP BY w),
    i AS (SELECT p.rid, w, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + CAST((25 * len(ws) * n) // l AS BIGINT)))) impact
          FROM p JOIN t USING (w) JOIN d ON d.rid = p.rid, s),
    r AS (SELECT q.rid q, item_id, i.rid, CAST(sum(times * impact) AS BIGINT) score FROM q JOIN i USING (w) GROUP BY ALL),
    k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
          FROM r JOIN d ON d.rid = r.rid WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20"""
