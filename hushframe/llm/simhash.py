"""SimHash fingerprints and near-duplicates among them by a self-join of binary tries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.shared import Bitmap, components, joined, staged

BITS = 64
#: The fingerprint is read in three bit orders, each beginning with another of these blocks of bits.
BLOCKS = (22, 21, 21)
#: Distinct fingerprints in a shard, as many as the top of a trie is split for on average.
SHARD = 2048
#: Node pairs that a traversal holds at once.
FRONTIER = 1 << 20
#: Pairs of leaves that a node pair is replaced by without going further down.
LEAF_PAIRS = 16
#: Texts, and shingles of all of them, of a block of candidates that one task compares with another block.
BLOCK_TEXTS = 2048
BLOCK_SHINGLES = 1 << 21


def fold_ascii(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes], width: int) -> list[bytes]:
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[k:] for k in range(width)))]


def fingerprint_of(text: str | None, width: int, seed: int, distinct: bool = False) -> int:
    """The bits that are set in over half of the shingles' hashes; 0 without words."""
    grams = shingles(fold_ascii(text), width)
    if not grams:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, seed) for g in (set(grams) if distinct else grams)), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int = 3, seed: int = 42, distinct: bool = False) -> Column:
    """A signed long of the fingerprint's bits."""

    @F.pandas_udf("long")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series(
            np.array([fingerprint_of(t, width, seed, distinct) for t in texts], np.uint64).view(np.int64), dtype="int64"
        )

    return bits(text)


def rotated(values: np.ndarray, by: int) -> np.ndarray:
    return values if by == 0 else (values << np.uint64(by)) | (values >> np.uint64(BITS - by))


def orders(budget: int) -> list[tuple[int, list[int]]]:
    """For each bit order: the rotation, and how many bits may differ after so many bits.

    Of the three turns of the blocks, at least one has within its first block at most a third of all differing bits,
    and within its first two at most two thirds (the cycle lemma), so that each pair within the budget is met in one.
    """
    out, by = [], 0
    for k in range(len(BLOCKS)):
        turned = BLOCKS[k:] + BLOCKS[:k]
        allowed = [budget * (j + 1) // len(BLOCKS) for j in range(len(BLOCKS)) for _ in range(turned[j])]
        out.append((by, allowed))
        by += BLOCKS[k]
    return out


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool, allowed: list[int], depth: int, diff: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the sorted arrays a and b whose values differ in at most allowed[-1] bits.

    Both are tries below nodes at ``depth``, whose prefixes differ in ``diff`` bits. Pairs of nodes go down together,
    bit by bit; a pair whose prefixes differ in more bits than allowed at its depth is dropped with all below it.
    Node pairs wait on a stack, so that memory is bounded. With ``same`` a is b and each pair is met once.
    """
    one, budget = np.uint64(1), allowed[-1]
    stack = [(depth, np.array([[0, len(a), 0, len(b), diff]], np.int64))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > FRONTIER // 4:
            half = len(pairs) // 2
            stack += [(depth, pairs[:half]), (depth, pairs[half:])]
            continue
        n = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        few = (n <= LEAF_PAIRS) if depth < BITS else np.ones(len(pairs), bool)
        if few.any():
            leaf, m = pairs[few], n[few]
            at = np.repeat(np.arange(len(leaf)), m)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
            width = (leaf[:, 3] - leaf[:, 2])[at]
            i, j = leaf[at, 0] + nth // width, leaf[at, 2] + nth % width
            ok = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                ok &= i < j
            if ok.any():
                yield i[ok], j[ok]
        pairs = pairs[~few]
        if not len(pairs):
            continue
        bit = np.uint64(BITS - 1 - depth)

        def split(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit=bit) -> np.ndarray:
            """Where the values of a node with the next bit set begin."""
            key = ((x[lo] >> bit) | one) << bit
            at = np.searchsorted(x, key)
            return np.minimum(np.maximum(at, lo), hi)

        mid_a, mid_b = split(a, pairs[:, 0], pairs[:, 1]), split(b, pairs[:, 2], pairs[:, 3])
        lo_a, hi_a, lo_b, hi_b, d = pairs.T
        below = [
            np.stack([lo_a, mid_a, lo_b, mid_b, d], 1),
            np.stack([mid_a, hi_a, mid_b, hi_b, d], 1),
            np.stack([lo_a, mid_a, mid_b, hi_b, d + 1], 1),
        ]
        other = np.stack([mid_a, hi_a, lo_b, mid_b, d + 1], 1)
        # Below a node paired with itself the two mixed pairs are one.
        below.append(other[(lo_a != lo_b) | (hi_a != hi_b)] if same else other)
        pairs = np.concatenate(below)
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= allowed[depth])]
        if len(pairs):
            stack.append((depth + 1, pairs))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Links that hold together what pairs hold together, at most n - 1, nearer pairs first within a batch.

    Also the root of each of the n, and the number of its pairs.
    """
    parent, degree = np.arange(n), np.zeros(n, np.int64)

    def root(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            x = parent[up]

    kept = []
    for i, j, d in pairs:
        degree += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        order = np.argsort(d, kind="stable")
        i, j = i[order], j[order]
        while len(i):
            ri, rj = root(i), root(j)
            apart = ri != rj
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            if not len(i):
                break
            # Each root hooks to a smaller one by its first link; hooks to smaller roots can't close a ring.
            hi, lo = np.maximum(ri, rj), np.minimum(ri, rj)
            who, first = np.unique(hi, return_index=True)
            parent[who] = lo[first]
            kept += zip(i[first].tolist(), j[first].tolist())
    return kept, root(np.arange(n)), degree


def hub_links(roots: np.ndarray, degree: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Of the pairs those with the member of a group that has most pairs, as a text has with its altered copies."""
    order = np.lexsort((-np.arange(len(roots)), degree, roots))
    hub = np.zeros(len(roots), bool)
    hub[order[np.append(roots[order][1:] != roots[order][:-1], True)]] = True
    out = []
    for i, j, _ in pairs:
        at = hub[i] | hub[j]
        out += zip(i[at].tolist(), j[at].tolist())
    return out


def hamming_forest(prints: DataFrame, budget: int, label: str, hubs: bool = False) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that differ in at most ``budget`` bits.

    Not all links come back but a forest from each pair of shards, which connects the same fingerprints: a group of
    m fingerprints that are all near each other gives m links, not m squared. With ``hubs`` the links of each group's
    best linked member come too, for callers that verify links: again no more than members.
    The top of the trie is dealt out: each fingerprint goes, for each bit order, to the pairs of prefixes within the
    first block's budget, and each task goes down below one such pair of nodes.
    """
    n = max(1, prints.count())
    k = min(16, max(4, math.ceil(math.log2(n / SHARD))))
    turns = orders(budget)
    ball = min(turns[0][1][0], k)
    flips = [0] + [1 << x for x in range(k)] * (ball >= 1) + [1 << x | 1 << y for x in range(k) for y in range(x)] * (ball >= 2)
    if ball > 2:
        raise ValueError("budgets over 8 bits are too wide for this join")
    rows = None
    for o, (by, _) in enumerate(turns):
        turned = F.col("fp") if by == 0 else F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", BITS - by))
        top = F.shiftrightunsigned(turned, BITS - k)
        part = prints.select("fp", F.lit(o).alias("o"), top.alias("p"))
        rows = part if rows is None else rows.union(part)
    balls = F.explode(F.array(*(F.lit(x).cast("bigint") for x in flips)))
    rows = rows.select("fp", "o", "p", balls.alias("x")).withColumn("q", F.col("p").bitwiseXOR(F.col("x"))).select(
        "fp", "o", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), (F.col("p") > F.col("q")).alias("right")
    )

    def descend(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        by, allowed = turns[int(key[0])]
        lo, hi = int(key[1]), int(key[2])
        values = rotated(group["fp"].to_numpy(np.int64).view(np.uint64), by)
        side = group["right"].to_numpy(bool)
        a = np.sort(values[~side])
        b = a if lo == hi else np.sort(values[side])
        diff = (lo ^ hi).bit_count()
        if not len(a) or not len(b) or diff > allowed[k - 1]:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        shift = 0 if lo == hi else len(a)
        both = a if lo == hi else np.concatenate([a, b])

        def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for i, j in near_pairs(a, b, lo == hi, allowed, k, diff):
                yield i, j + shift, np.bitwise_count(a[i] ^ b[j])

        links, roots, degree = forest(len(both), found())
        if hubs and links:
            links += hub_links(roots, degree, found())
        links = np.array(links, np.int64).reshape(-1, 2)
        back = rotated(both, (BITS - by) % BITS).view(np.int64)
        return pd.DataFrame({"a": back[links[:, 0]], "b": back[links[:, 1]]})

    return staged(rows.groupBy("o", "lo", "hi").applyInPandas(descend, "a long, b long"), label)


def simhash_classes(docs: DataFrame, width: int = 3, budget: int = 2, seed: int = 42, max_link_bits: int = 8) -> DataFrame:
    """One row for each row of docs: doc_id, fp, fingerprint (hexadecimal) and component_id.

    Rows with equal fingerprints are linked, and so are fingerprints that differ in at most ``budget`` bits;
    component_id is the least doc_id that links lead to. Texts without words have fingerprint zero and link like any
    other. Null doc_ids keep their rows and take no part in the minimum (component_id is null if there are only
    such). Rows that repeat a doc_id give a row each. An empty table gives no rows; further columns are ignored.
    """
    if budget > max_link_bits:
        raise ValueError("the budget is too wide for this join")
    own = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), fingerprint(F.col("text"), width, seed).alias("fp"))
    marked = staged(own, "simhash-prints")
    firsts = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    links = hamming_forest(firsts.select("fp"), budget, "simhash-links")
    roots = components(links, "simhash-components")
    named = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    classes = joined(named.select("fp", "root", F.col("n").alias("rows")), staged(least, "simhash-least"), ["root"], "fp")
    classes = staged(classes.select("fp", "component_id", F.col("rows").alias("n")), "simhash-classes")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return joined(marked, classes, ["fp"], "row").select("doc_id", "fp", hexed.alias("fingerprint"), "component_id")


def parities(grams: np.ndarray) -> tuple[int, int]:
    """How many bits, and for each whether an odd number of the set's hashes falls to it.

    Two sets' bits differ in no more places than there are shingles in one set only.
    """
    width = max(64, 1 << (2 * len(grams) - 1).bit_length())
    odd = np.bincount((grams.view(np.uint64) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return width, int.from_bytes(np.packbits(odd.astype(bool), bitorder="little").tobytes(), "little")


def folded(width: int, bits: int, to: int) -> int:
    """The parities in fewer bits."""
    while width > to:
        width //= 2
        bits = (bits >> width) ^ (bits & ((1 << width) - 1))
    return bits


def remaining_links(group: pd.DataFrame, similarity: float, budget: int) -> list[tuple[int, int]]:
    """Links between the classes (cls) of the rows of two blocks, or of one: node, block, n, s (sorted hashes), fps.

    Each pair of the blocks' texts within ``budget`` bits in one of the fingerprints is compared, unless links already
    hold the two together or the sizes or parities of their sets leave no room for the similarity.
    """
    group = group.sort_values(["block", "node"], ignore_index=True)
    nodes, sets, block = group["node"].to_numpy(), group["s"].to_list(), group["block"].to_numpy()
    n = np.array([len(x) for x in sets], np.int64)
    prints = [np.array(x, np.int64).view(np.uint64) for x in zip(*group["fps"])]
    _, label = np.unique(group["cls"].to_numpy(), return_inverse=True)
    # Members of each class, so that classes meet by whole arrays.
    members = {c: np.flatnonzero(label == c) for c in range(label.max() + 1)}
    bits: dict[int, tuple[int, int]] = {}
    single, out = block[0] == block[-1], []
    first = 0 if single else int(np.searchsorted(block, block[-1]))
    for i in range(len(nodes) if single else first):
        begin = i + 1 if single else first
        near = np.zeros(len(nodes) - begin, bool)
        for p in prints:
            near |= np.bitwise_count(p[begin:] ^ p[i]) <= budget
        near &= (label[begin:] != label[i]) & (np.minimum(n[begin:], n[i]) >= similarity * np.maximum(n[begin:], n[i]))
        for j in (np.flatnonzero(near) + begin).tolist():
            if label[i] == label[j] or not n[i]:
                continue
            for x in (i, j):
                if x not in bits:
                    bits[x] = parities(sets[x])
            (wi, bi), (wj, bj) = bits[i], bits[j]
            if wi != wj:
                bi, bj = folded(wi, bi, wj), folded(wj, bj, wi)
            # shared >= similarity * (both - shared), and both - 2 shared >= the differing bits.
            both = int(n[i] + n[j])
            if both - (bi ^ bj).bit_count() < 2 * similarity / (1 + similarity) * both - 1e-6:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if shared / (both - shared) >= similarity:
                out.append((int(nodes[i]), int(nodes[j])))
                old, new = sorted((int(label[i]), int(label[j])), key=lambda c: len(members[c]))
                label[members[old]] = new
                members[new] = np.concatenate([members[new], members.pop(old)])
    return out


def links_left(met: DataFrame, sets: DataFrame, similarity: float, budget: int) -> DataFrame:
    """Links between classes of verified links (met: a, b, ok) that candidates left out of met would make.

    All pairs of texts within the budget lie in one component of met, verified or not. A component is settled if its
    verified links hold it together or all its pairs are in met; each other one is dealt out in blocks, and each pair
    of blocks is compared in a task of its own. sets has node, s and fps.
    """
    classes = components(met.where("ok").select("a", "b"), "near-classes").withColumnRenamed("root", "cls")
    nodes = met.select(F.col("a").alias("node")).union(met.select("b")).distinct()
    classed = staged(nodes.join(classes, "node", "left").withColumn("cls", F.coalesce("cls", "node")), "near-classed")
    # Candidates between classes, each two once: far fewer than candidates, most of which one class holds.
    end = lambda x: classed.select(F.col("node").alias(x), F.col("cls").alias(f"c{x}"))
    between = met.where("NOT ok").join(end("a"), "a").join(end("b"), "b").where("ca != cb")
    apart = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "near-candidates")
    sizes = classed.groupBy("cls").agg(F.count("*").alias("n")).join(apart.withColumnRenamed("node", "cls"), "cls", "left")
    sizes = staged(sizes.select("cls", "n", F.coalesce("root", "cls").alias("root")), "near-sizes")
    within = staged(joined(classed, sizes, ["cls"], "node"), "near-within")
    members = staged(within.join(sets.select("node", F.size("s").alias("n")), "node"), "near-members")
    tested = met.join(within.select(F.col("node").alias("a"), "root"), "a").groupBy("root").agg(F.count("*").alias("tested"))
    size = members.groupBy("root").agg(
        F.count("*").alias("m"), F.sum("n").alias("shingles"), (F.min("cls") != F.max("cls")).alias("parted")
    )
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    unsettled = size.join(tested, "root").where("parted AND tested < m * (m - 1) / 2").select("root", blocks.alias("g"))
    rows = members.join(unsettled, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("g")))
    rows = rows.select("root", "node", "cls", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("g") - 1)).alias("x"))
    rows = rows.select("root", F.least("block", "x").alias("lo"), F.greatest("block", "x").alias("hi"), "node", "cls", "block")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        links = np.array(remaining_links(group, similarity, budget), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    return rows.join(sets, "node").groupBy("root", "lo", "hi").applyInPandas(compare, "a long, b long")


def near_duplicate_links(docs: DataFrame, width: int = 5, similarity: float = 0.8, budget: int = 8, seeds: tuple[int, ...] = (42, 43)) -> DataFrame:
    """Links (a, b) between the nodes (hashes) of different texts whose ``width``-word shingle sets are that similar.

    Similarity is the Jaccard index. Candidates come from fingerprints of word pairs, which an edit disturbs less than
    it does longer shingles: two independent ones, each joined within ``budget`` bits. Of the candidates a forest and
    the links of each group's best linked member are verified on the texts' shingles first, and then all others whose
    texts these links leave apart; links that join what others hold together don't come back. At the similarity 0.8 a pair's
    fingerprints differ in about 6 of 64 bits, so that a few in a hundred such pairs are in neither join.
    """
    texts = docs.select(F.xxhash64("text").alias("node"), "text")
    prints = [fingerprint(F.col("text"), 2, s, distinct=True).alias(f"fp{i}") for i, s in enumerate(seeds)]
    marked = staged(texts.select("node", *prints), "near-prints").distinct()
    pairs = None
    for i in range(len(seeds)):
        own = marked.select("node", F.col(f"fp{i}").alias("fp"))
        firsts = staged(own.groupBy("fp").agg(F.min("node").alias("first")), "near-distinct")
        links = hamming_forest(firsts.select("fp"), budget, "near-links", hubs=True)
        across = links.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("u")), "a").join(
            firsts.select(F.col("fp").alias("b"), F.col("first").alias("v")), "b"
        )
        within = own.join(firsts, "fp").where("node != first").select(F.col("node").alias("u"), F.col("first").alias("v"))
        both = across.select("u", "v").union(within)
        pairs = both if pairs is None else pairs.union(both)
    pairs = staged(pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "near-met")

    @F.pandas_udf("array<long>")
    def shingle_set(batch: pd.Series) -> pd.Series:
        out = []
        for text in batch:
            grams = set(shingles(fold_ascii(text), width))
            out.append(np.sort(np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), np.uint64)).view(np.int64))
        return pd.Series(out)

    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = texts.join(needed, "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text"))
    fps = marked.select("node", F.array(*(f"fp{i}" for i in range(len(seeds)))).alias("fps"))
    sets = staged(sets.select("node", shingle_set("text").alias("s")).join(fps, "node"), "near-shingles")
    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b"
    )
    shared = F.size(F.array_intersect("sa", "sb"))
    ratio = F.try_divide(shared, F.size("sa") + F.size("sb") - shared)
    met = staged(full.select("a", "b", F.coalesce(ratio >= similarity, F.lit(False)).alias("ok")), "near-verified")
    left = links_left(met, sets, similarity, budget)
    return staged(met.where("ok").select("a", "b").union(left), "near-links-all")


def without_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near-duplicates: the one of least doc_id.

    Equal texts are in one group, and so are texts that links lead to (see ``near_duplicate_links``). All null texts
    are one group, and all texts without a word that are equal. Null doc_ids come last; of rows that agree in doc_id
    and text one stays. docs' columns, whatever their names. Documents that a bitmap shows to be alone in their group
    pass as they lie; only the others are shuffled.
    """
    last = F.lit(2**63 - 1)
    roots = components(near_duplicate_links(docs, width, similarity), "near-components")
    id_, node = F.coalesce("doc_id", last).alias("id"), F.xxhash64("text").alias("node")
    texts = docs.select(id_, node).groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    texts = staged(texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", F.when(F.col("n") > 1, F.col("node")))), "near-texts")
    bits = Bitmap(texts.where("root IS NOT NULL").select("node"), "near-bits")
    # The least document of a group, and its text; of what the bitmap lets through beside groups, itself.
    there = bits.marked(texts, "node", "there").where("there").groupBy(F.coalesce("root", "node").alias("root"))
    kept = staged(there.agg(F.min(F.struct("id", "node")).alias("k")).select("k.id", "k.node"), "near-kept")
    rows = bits.marked(docs.select(F.struct("*").alias("row"), id_, node), "node", "there")
    one = rows.where("there").dropDuplicates(["id", "node"]).join(kept, ["id", "node"], "left_semi").select("row")
    return rows.where("NOT there").select("row").union(one).select("row.*")
