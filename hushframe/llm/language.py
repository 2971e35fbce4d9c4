"""Language identification with bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.shared import held_out, staged

#: Training documents of a language, about, and n-grams of a language in the filter, at most.
SAMPLE_DOCS = 1_000
GRAMS = 40_000
#: n-grams lie within a word, whose edges count as a character.
LENGTHS = (2, 3, 4, 5)
HASHES = 3
#: Code points handled at once.
PIECE = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """A hash of each n-gram of the text's lower-cased letters; anything else is the edge of a word."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    edge = code == 32
    inner = np.concatenate([[0], np.cumsum(edge)])
    out = []
    for n in LENGTHS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h *= np.uint64(0x100000001B3)
            h += code[k : k + m]
        # No edge but at the ends, and not at both ends of a single edge pair.
        ok = inner[n - 1 : n - 1 + m] == inner[1 : 1 + m] if n > 2 else ~(edge[:m] & edge[1 : 1 + m])
        out.append(h[ok])
    h = np.concatenate(out) if out else np.zeros(0, np.uint64)
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def pieces(text: str) -> Iterator[str]:
    for k in range(0, len(text), PIECE):
        yield text[k : k + PIECE]


class SlicedFilter:
    """One table of slots for all languages: bit l of a slot belongs to language l's Bloom filter."""

    def __init__(self, langs: list[str], members: list[np.ndarray], prior: list[int]):
        self.langs, self.words = langs, -(-max(1, len(langs)) // 64)
        size = max(1, sum(map(len, members)) // max(1, len(members)))
        self.bits = min(24, max(12, int(np.ceil(np.log2(8 * size * HASHES)))))
        self.table = np.zeros((self.words, 1 << self.bits), np.uint64)
        for l, hashes in enumerate(members):
            for slot in self._slots(hashes):
                self.table[l // 64, slot] |= np.uint64(1) << np.uint64(l % 64)
        fill = [float(((self.table[l // 64] >> np.uint64(l % 64)) & np.uint64(1)).mean()) for l in range(len(langs))]
        self.false = np.array(fill) ** HASHES
        #: The most frequent language, for texts of unknown letters only.
        self.usual = int(np.argmax(prior)) if prior else 0

    def _slots(self, h: np.ndarray) -> list[np.ndarray]:
        mask, step = np.uint64((1 << self.bits) - 1), (h >> np.uint64(40)) | np.uint64(1)
        return [((h + np.uint64(k) * step) & mask).astype(np.int64) for k in range(HASHES)]

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """By language the n-grams found in its filter; all n-grams."""
        found, n = np.zeros(len(self.langs), np.int64), 0
        for part in pieces(text):
            h = grams(part)
            n += len(h)
            slots = self._slots(h)
            for w in range(self.words):
                hit = self.table[w][slots[0]]
                for s in slots[1:]:
                    hit &= self.table[w][s]
                masks, times = np.unique(hit, return_counts=True)
                for l in range(w * 64, min(len(self.langs), w * 64 + 64)):
                    found[l] += times[(masks >> np.uint64(l % 64)) & np.uint64(1) == 1].sum()
        return found, n

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(_letters()[np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32)].any() for p in pieces(text)):
            return "und", 0.0
        found, n = self.counts(text)
        # What is left once the expected false positives among the other n-grams are taken off.
        true = np.maximum(0.0, (found - n * self.false) / np.maximum(1e-9, 1 - self.false))
        if not true.any():
            return self.langs[self.usual], 0.0
        best = int(np.argmax(true))
        return self.langs[best], float(min(1.0, true[best] / true.sum()))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, max_grams: int = GRAMS) -> SlicedFilter:
    """A filter from about ``sample_docs`` documents of each language (by a hash of doc_id), outside the held-out fifth.

    An n-gram belongs to a language if it occurs in at least two of its sampled documents (in one, where there are
    under 20); the ``max_grams`` that most documents have are kept. Rows without text or lang teach nothing.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return SlicedFilter([], [], [])
    rates = docs.sparkSession.createDataFrame([(x, min(1.0, sample_docs / sizes[x])) for x in langs], "lang string, rate double")
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 11) / F.lit(float(2**53))
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(rates), "lang").where(chance < F.col("rate"))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                each = [grams(p) for p in pieces(text)]
                h = np.unique(np.concatenate(each)) if each else np.zeros(0, np.uint64)
                yield pd.DataFrame({"lang": lang, "gram": h.view(np.int64)})

    n_docs = F.count("*").alias("n")
    counts = staged(
        sample.select("lang", "text").mapInPandas(found, "lang string, gram long").groupBy("lang", "gram").agg(n_docs),
        "language-grams",
    )
    taken = {x: min(sizes[x], sample_docs) for x in langs}
    often = F.col("n") >= F.when(F.col("lang").isin([x for x in langs if taken[x] < 20]), 1).otherwise(2)
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.where(often).withColumn("k", F.row_number().over(best)).where(F.col("k") <= max_grams)
    members: dict[str, list[int]] = {x: [] for x in langs}
    for r in rows.select("lang", "gram").toLocalIterator():
        members[r["lang"]].append(r["gram"])
    return SlicedFilter(langs, [np.array(members[x], np.int64).view(np.uint64) for x in langs], [sizes[x] for x in langs])


def identify(docs: DataFrame, model: SlicedFilter) -> DataFrame:
    """Adds lang_pred and score (the predicted language's share of all corrected popcounts) to each row of docs.

    Null texts and texts without a letter are ``und`` with score 0, and so are all if no language was learned; letters
    of which no filter knows an n-gram give the most frequent language with score 0. Ties go to the language first in code-point order. All columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in batch], columns=["lang_pred", "score"])

    return docs.withColumn("_l", predict("text")).select(*docs.columns, "_l.lang_pred", "_l.score")


def language_of_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score. No labelled row at all: lang_pred is ``und``."""
    model = train(docs)
    return identify(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model).drop("text")
