"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.shared import staged

#: Words of a window.
WINDOW = 10
#: UTF-8 bytes of benchmark text in one broadcast, whose index takes up to some 25 times as much (200 MB); a larger
#: benchmark is scanned for in as many blocks as it needs.
BLOCK_BYTES = 8 << 20

#: Every ASCII byte but digits and letters parts words; capitals become small letters.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Windows:
    """The windows of benchmark items in arrays: all items' words by number, and by length of window the rolling hashes
    in order, each with the place of its words and its item. A word's number is its only entry in a dictionary."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.items: list[object] = []
        number, parts, places = self.numbers, [], {}
        at = 0
        for item, text in items:
            ids = np.fromiter((number.setdefault(w, len(number) + 1) for w in words_of(text)), np.uint32)
            if len(ids):
                n = min(window, len(ids))
                count = len(ids) - n + 1
                places.setdefault(n, []).append((at + np.arange(count), np.full(count, len(self.items), np.int32)))
                self.items.append(item)
                parts.append(ids)
                at += len(ids)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        self.tables = {}
        for n, found in places.items():
            place, item = (np.concatenate(x) for x in zip(*found))
            known = self.rolling(self.words.astype(np.uint64), n)[place]
            order = np.lexsort((item, known))
            known, place, item = known[order], place[order], item[order]
            # A window that an item repeats is kept once.
            again = np.zeros(len(known), bool)
            again[1:] = (known[1:] == known[:-1]) & (item[1:] == item[:-1])
            for k in np.flatnonzero(again).tolist():
                again[k] = (self.words[place[k] : place[k] + n] == self.words[place[k - 1] : place[k - 1] + n]).all()
            self.tables[n] = known[~again], place[~again], item[~again]

    @staticmethod
    def rolling(ids: np.ndarray, n: int) -> np.ndarray:
        """A hash of each n consecutive numbers."""
        mixed = (ids + np.uint64(1)) * _MULTIPLY
        mixed ^= mixed >> np.uint64(29)
        out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        for k in range(n):
            out *= np.uint64(0x100000001B3)
            out += mixed[k : k + len(out)]
        return out

    def find(self, words: list[bytes]) -> list[tuple[int, int, list]]:
        """Verified occurrences in order: first word, number of words, items."""
        if not words or not self.tables:
            return []
        get = self.numbers.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        found = []
        for n, (known, place, item) in self.tables.items():
            rolled = self.rolling(ids, n)
            if not len(rolled):
                continue
            first = np.minimum(np.searchsorted(known, rolled), len(known) - 1)
            for at in np.flatnonzero(known[first] == rolled).tolist():
                end = np.searchsorted(known, rolled[at], "right")
                own = ids[at : at + n]
                items = [
                    self.items[item[k]]
                    for k in range(first[at], end)
                    if (self.words[place[k] : place[k] + n] == own).all()
                ]
                if items:
                    found.append((at, n, items))
        return sorted(found, key=lambda x: x[:2])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open word ranges, joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, limit: int) -> list[DataFrame]:
    """The benchmark in parts by a hash of its items, each within the limit if its items are evenly long."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = -(-max(total, 1) * (2 if total > limit else 1) // limit)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [benchmark] if n == 1 else [benchmark.where(part == k) for k in range(n)]


FOUND = "n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, cut: bool = False
) -> DataFrame:
    """row (each row of docs) and _found: n_words, spans (word ranges inside occurrences of benchmark windows) and items;
    if asked to cut, also kept, the text without its spans, null where it has none.

    Words and windows are those of the module's ``words_of`` (ASCII letters lower-cased; letters, digits and all
    non-ASCII characters make words); an item of fewer words than a window is one window, an item of none has none.
    Within the byte limit the benchmark is one broadcast and docs are scanned once without a shuffle. A larger one is
    broadcast block by block, each block in a scan of its own, and a row's results are put together by a row number.
    Null and empty texts have no words and no hits. Repeated rows are scanned each. Items that repeat an item_id
    count as one item; null item_ids are left out of items but their windows hit. Columns of docs may have any names.

    A task has one Python worker at a time: each that runs beside another stays with the executor, to be used again, and
    takes some 100 MB. So a scan within the limit also cuts, and its function counts as not deterministic, or
    a filter on what it finds would make Spark run it twice.
    """
    spark = docs.sparkSession
    blocks, docs = _blocks(benchmark, block_bytes), docs.select(F.struct("*").alias("row"))
    at_once = cut and len(blocks) == 1

    def scan(rows: DataFrame, part: DataFrame) -> DataFrame:
        items = [(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()]
        known = spark.sparkContext.broadcast(Windows(items, window))

        @F.pandas_udf(f"{FOUND}, kept string" if at_once else FOUND)
        def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            index = known.value
            for batch in texts:
                n_words, spans, names, kept = [], [], [], []
                for text in batch:
                    words = words_of(text)
                    hits = index.find(words)
                    hit = merged([(at, at + n) for at, n, _ in hits])
                    n_words.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in hit])
                    names.append(sorted({str(i) for _, _, x in hits for i in x if i is not None}))
                    kept.append(without_words(text, hit) if at_once and hit else None)
                out = pd.DataFrame({"n_words": n_words, "spans": spans, "items": names})
                yield out.assign(kept=pd.Series(kept, dtype=object)) if at_once else out

        return rows.withColumn("_found", find.asNondeterministic()("row.text"))

    if len(blocks) == 1:
        out = scan(docs, blocks[0])
    else:
        rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminate-rows")
        parts = [scan(rows, b).select("_row", "_found.*") for b in blocks]
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        together = every.groupBy("_row").agg(
            F.struct(
                F.first("n_words").alias("n_words"),
                F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            ).alias("_found")
        )
        out = rows.join(together, "_row").drop("_row")
        if cut:

            @F.pandas_udf("string")
            def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
                # All rows come here, whatever condition stands around the call.
                return pd.Series(
                    [without_words(t, [(s["start"], s["end"]) for s in x]) if len(x) else None for t, x in zip(texts, spans)], dtype=object
                )

            out = out.withColumn("_found", F.col("_found").withField("kept", kept("row.text", "_found.spans")))
    return out


def hit_words(spans) -> F.Column:
    """Words inside the union of sorted, possibly overlapping ranges."""
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
    )
    return step["n"].cast("bigint")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    items = F.col("_found.items")
    return (
        benchmark_hits(docs.select("doc_id", "text"), benchmark, window)
        .select(
            "row.doc_id",
            F.col("_found.n_words").alias("n_words"),
            hit_words(F.col("_found.spans")).alias("n_hit"),
            F.size(items).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_share: float = 0.5) -> DataFrame:
    """docs without benchmark passages: hit words go out of the text, and documents hit in over ``max_share`` go.

    A hit span is cut from its first word to the start of the next word outside it (to the end of the text if there is
    none). Rows without hits pass unchanged, null and empty texts too, and so do all other columns.
    """
    spans = F.col("_found.spans")
    share = hit_words(spans) / F.col("_found.n_words")
    found = benchmark_hits(docs, benchmark, window, cut=True).where((F.size(spans) == 0) | (share <= F.lit(max_share)))
    text = F.when(F.size(spans) > 0, F.col("_found.kept")).otherwise(F.col("row.text"))
    return found.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given ranges of words."""
    raw = text.encode("utf-8", "surrogatepass")
    folded, starts, at = raw.translate(_FOLD), [], 0
    for word in folded.split():
        at = folded.index(word, at)
        starts.append(at)
        at += len(word)
    starts.append(len(raw))
    keep, last = [], 0
    for start, end in merged(spans):
        keep.append(raw[last : starts[start]])
        last = starts[end]
    return b"".join([*keep, raw[last:]]).decode("utf-8", "surrogatepass").strip()


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
