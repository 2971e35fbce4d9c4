"""Phrase collocation mining with pivot partitioning: every n-gram is counted where its rarest word is."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.shared import Bitmap, joined, staged

#: Words of the longest phrase.
LONGEST = 4
#: The most frequent words that get a number in a dictionary, which is broadcast; all others go by a hash.
DICTIONARY = 400_000
#: Fragments of a pivot that one task counts, about.
PART = 200_000
#: Words of a chunk that is cut into fragments at once.
CHUNK = 1 << 19

#: Capitals become small letters, and what parts pieces a line feed.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def pieces_of(text: str | None) -> list[list[bytes]]:
    """Words of each piece; pieces end at . , ; : ! ? and line breaks, words at spaces and tabs."""
    return [p.split() for p in text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b"\n")] if text else []


def _lang(lang) -> str:
    return "und" if lang is None or lang != lang else lang


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f: occurrences of each word in each language's texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(b["lang"], b["text"]):
                if text:
                    folded = text.encode("utf-8", "surrogatepass").translate(_FOLD)
                    found.setdefault(_lang(lang), Counter()).update(folded.split())
            rows = [(lang, w.decode("utf-8", "surrogatepass"), n) for lang, c in found.items() for w, n in c.items()]
            yield pd.DataFrame(rows, columns=["lang", "word", "f"])

    rows = docs.select(F.col("lang").cast("string"), "text").mapInPandas(count, "lang string, word string, f long")
    return rows.groupBy("lang", "word").agg(F.sum("f").alias("f"))


class Numbers:
    """A number for each word of each language: the rarer, the higher. Words of the dictionary have their places by
    frequency, others their hash above these, or none if they are too rare to be in any phrase."""

    BREAK = np.iinfo(np.int64).max

    def __init__(self, top: list, salt: bytes, slices: int, bits: dict[int, bytes]):
        """top: rows of lang, word, f, the most frequent first. slices, bits: a bitmap of the hashes of other words."""
        self.words: dict[str, dict[bytes, int]] = {}
        for k, r in enumerate(top):
            self.words.setdefault(r["lang"], {})[r["word"].encode("utf-8", "surrogatepass")] = k
        self.parts = np.array([-(-r["f"] // PART) for r in top] or [1], np.int64)
        self.size, self.salt, self.slices = len(top), salt, slices
        self.bits = {k: np.frombuffer(v, np.uint8) for k, v in bits.items()}

    def rare(self, word: bytes, lang: bytes) -> int:
        """The number of a word outside the dictionary."""
        h = xxhash.xxh64_intdigest(lang + b"\n" + word + self.salt, 42)
        spot = (h - (1 << 64) if h >> 63 else h) % (self.slices << 15)
        held = self.bits.get(spot >> 15)
        place = spot & 32767
        if held is None or not held[place >> 3] >> (place & 7) & 1:
            return self.BREAK
        return self.size + (h >> 2)

    def of(self, words: list[bytes], lang: str) -> list[int]:
        get = self.words.get(lang, {}).get
        if not self.slices:
            return [get(w, self.BREAK) for w in words]
        own = lang.encode("utf-8", "surrogatepass")
        return [k if (k := get(w)) is not None else self.rare(w, own) for w in words]


SLOTS = [f"l{k}" for k in range(LONGEST - 1, 0, -1)] + ["pivot"] + [f"r{k}" for k in range(1, LONGEST)]


def fragments_of(ids: np.ndarray) -> np.ndarray:
    """A row for each word as a pivot: the LONGEST - 1 words on each side as far as none is rarer, -1 beyond.

    ids: numbers of words, Numbers.BREAK between pieces and for words that are in no phrase. To the left the pivot
    itself doesn't come again, so that an n-gram belongs to the first of its pivots. Pivots alone are left out.
    """
    side, n = LONGEST - 1, len(ids)
    padded = np.concatenate([np.full(side, Numbers.BREAK), ids, np.full(side, Numbers.BREAK)])
    out = np.full((n, 2 * side + 1), -1, np.int64)
    out[:, side] = ids
    for sign, frequent in ((-1, np.less), (1, np.less_equal)):
        goes = ids != Numbers.BREAK
        for k in range(1, side + 1):
            word = padded[side + sign * k : side + sign * k + n]
            goes = goes & frequent(word, ids)
            out[goes, side + sign * k] = word[goes]
    return out[(out[:, side - 1] >= 0) | (out[:, side + 1] >= 0)]


def combined(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows once, and how often each was there."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    key = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        key = (key ^ rows[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    rows = rows[np.argsort(key, kind="stable")]
    first = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
    return rows[first], np.diff(np.append(np.flatnonzero(first), len(rows)))


def fragments(docs: DataFrame, numbers: Numbers) -> DataFrame:
    """pivot, its neighbours (SLOTS; -1 where there is none), part and n of each fragment of docs; a pivot's fragments are
    dealt out to as many parts as its frequency asks for."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value

        def chunk(ids: list[int]) -> pd.DataFrame:
            rows, n = combined(fragments_of(np.array(ids, np.int64)))
            mixed = (rows * np.arange(1, 2 * LONGEST, dtype=np.int64) * 0x9E3779B1).sum(axis=1) >> 16
            part = mixed % parts_of(rows[:, LONGEST - 1], known.parts)
            return pd.DataFrame({c: rows[:, k] for k, c in enumerate(SLOTS)}).assign(part=part.astype(np.int32), n=n)

        ids: list[int] = []
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                lang = _lang(lang)
                for words in pieces_of(text):
                    if len(words) > 1:
                        ids += known.of(words, lang)
                        ids.append(Numbers.BREAK)
                if len(ids) > CHUNK:
                    yield chunk(ids)
                    ids = []
        yield chunk(ids)

    schema = ", ".join([*(f"{c} long" for c in SLOTS), "part int", "n long"])
    return docs.select(F.col("lang").cast("string"), "text").mapInPandas(cut, schema)


def parts_of(pivots: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """In how many parts each pivot is counted: parts by number; words beyond the dictionary are rare enough for one."""
    return np.where(pivots < len(parts), parts[np.minimum(pivots, len(parts) - 1)], 1)


WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def counted(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, the sum of n of each, and that sum for each row as given."""
    key = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        key = (key ^ rows[:, c].astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    new = np.append(True, (rows[order[1:]] != rows[order[:-1]]).any(axis=1))
    if (new[1:] & (key[order[1:]] == key[order[:-1]])).any():
        # Different rows share a hash: sort by what they hold.
        order = np.lexsort(rows.T[::-1])
        new = np.append(True, (rows[order[1:]] != rows[order[:-1]]).any(axis=1))
    first = np.flatnonzero(new)
    sums = np.add.reduceat(n[order], first)
    each = np.empty(len(rows), np.int64)
    each[order] = sums[np.cumsum(new) - 1]
    return rows[order[first]], sums, each


def grams_of(frags: np.ndarray, n: np.ndarray, whole: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams (LONGEST numbers, -1 beyond the end) that hold their fragment's pivot, and their occurrences.

    Of pivots that are ``whole`` here only n-grams of at least so many occurrences: longer ones are looked for where
    what they hold with the pivot was frequent. Of others all, as more of each may be counted elsewhere.
    """
    side = LONGEST - 1
    frequent, found, times = {(0, 0): np.ones(len(frags), bool)}, [], []
    for size in range(2, LONGEST + 1):
        for left in range(size):
            right = size - 1 - left
            slots = slice(side - left, side + right + 1)
            ok = (frags[:, slots.start] >= 0) & (frags[:, slots.stop - 1] >= 0)
            for shorter in ((left - 1, right), (left, right - 1)):
                if min(shorter) >= 0:
                    ok &= frequent[shorter]
            at = np.flatnonzero(ok)
            mark = np.zeros(len(frags), bool)
            if len(at):
                rows, sums, each = counted(frags[at, slots], n[at])
                mark[at] = (each >= least) | ~whole[at]
                # A whole pivot's n-grams stand or fall together, so that the first row of each tells.
                keep = (sums >= least) | ~whole_of(rows[:, left], frags[at, side], whole[at])
                out = np.full((int(keep.sum()), LONGEST), -1, np.int64)
                out[:, :size] = rows[keep]
                found.append(out)
                times.append(sums[keep])
            frequent[left, right] = mark
    if not found:
        return np.zeros((0, LONGEST), np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(times)


def whole_of(pivots: np.ndarray, known: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """whole, which is given for pivots in ``known``, for each of ``pivots``."""
    parted = np.unique(known[~whole])
    return ~np.isin(pivots, parted) if len(parted) else np.ones(len(pivots), bool)


def mined(frags: DataFrame, numbers: Numbers, least: int) -> DataFrame:
    """w1 to w4 (numbers; -1 beyond the phrase's end) and a of each n-gram of two words or more that occurs at least so
    often. Fragments meet by pivot, in order; whole pivots are counted together, some CHUNK fragments at once."""
    shared = frags.sparkSession.sparkContext.broadcast(numbers.parts)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        rows = 0
        for b in batches:
            held.append(b.to_numpy(np.int64))
            rows += len(b)
            if rows >= CHUNK:
                block = np.concatenate(held)
                # The last pivot may go on in the next batch.
                end = np.searchsorted(block[:, LONGEST - 1], block[-1, LONGEST - 1])
                if end:
                    yield table(block[:end])
                held, rows = [block[end:]], len(block) - end
        if rows:
            yield table(np.concatenate(held))

    def table(block: np.ndarray) -> pd.DataFrame:
        frags_, n = block[:, :-1], block[:, -1]
        whole = parts_of(frags_[:, LONGEST - 1], shared.value) == 1
        grams, times = grams_of(frags_, n, whole, least)
        return pd.DataFrame({w: grams[:, k] for k, w in enumerate(WORDS)}).assign(a=times)

    met = frags.repartition("pivot", "part").sortWithinPartitions("pivot").select(*SLOTS, "n")
    met = met.mapInPandas(count, ", ".join([*(f"{w} long" for w in WORDS), "a long"]))
    # What whole pivots give is final; the parts of others add up.
    return met.groupBy(*WORDS).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def numbered(words: DataFrame, least: int, size: int) -> tuple[Numbers, DataFrame]:
    """Numbers of the words (lang, word, f) that occur at least so often, and a table of them: lang, w, word, f."""
    spark = words.sparkSession
    level = F.floor(F.log2(F.col("f").cast("double")) * 16).cast("int")
    words = words.withColumn("level", level)
    frequent = words.where(F.col("f") >= least)
    # At most 64 * 16 levels.
    levels = sorted(((r["level"], r["count"]) for r in frequent.groupBy("level").count().collect()), reverse=True)
    held, lowest = 0, None
    for at, n in levels:
        if held + n > size:
            break
        held, lowest = held + n, at
    inside = F.lit(False) if lowest is None else F.col("level") >= lowest
    top = sorted(frequent.where(inside).select("lang", "word", "f").collect(), key=lambda r: (-r["f"], r["lang"], r["word"]))
    names = "lang string, w long, word string, f long"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(top_.value[k][0], k, *top_.value[k][1:]) for k in b["id"].tolist()], columns=["lang", "w", "word", "f"])

    top_ = spark.sparkContext.broadcast([tuple(r) for r in top])
    table = spark.range(len(top)).mapInPandas(rows, names)
    if held == sum(n for _, n in levels):
        return Numbers(top, b"", 0, {}), staged(table, "phrase-names")
    others = words.where(~inside)
    salt = ""
    while True:
        h = F.xxhash64(F.concat("lang", F.lit("\n"), "word", F.lit(salt)))
        others = others.withColumns({"h": h, "w": F.shiftrightunsigned(h, 2) + len(top)})
        same = others.groupBy("w").agg(F.count("*").alias("k"), F.max("f").alias("f"))
        if not same.where((F.col("k") > 1) & (F.col("f") >= least)).limit(1).count():
            break
        salt += "\0"  # two words share a hash: all take another
    rare = others.where(F.col("f") >= least)
    bitmap = Bitmap(rare.select("h"), "phrase-bits")
    bits = {r["_cut"]: bytes(r["_bits"]) for r in bitmap.rows.collect()}  # 32 MiB at most
    return Numbers(top, salt.encode(), bitmap.slices, bits), staged(table.unionByName(rare.select("lang", "w", "word", "f")), "phrase-names")


def _slices(first: int, last: int) -> list[Column]:
    """v1 to v4: the words from first to last (from 1), then -1."""
    own = [F.col(w) for w in WORDS[first - 1 : last]]
    return [w.alias(f"v{k}") for k, w in enumerate(own + [F.lit(-1).cast("bigint")] * (LONGEST - len(own)), 1)]


def _of_sizes(what) -> Column:
    """An array of structs by the number of a phrase's words: ``what`` gives them for a number."""
    size = sum((F.col(w) >= 0).cast("int") for w in WORDS)
    out = F.when(size == 2, F.array(*what(2)))
    for n in range(3, LONGEST + 1):
        out = out.when(size == n, F.array(*what(n)))
    return out


def collocations(docs: DataFrame, least: int = 30, inside: tuple[int, int] = (80, 100), top: int = 2000, dictionary: int = DICTIONARY) -> DataFrame:
    """Returns lang, rank (from 1), phrase, a, l, r, n and score: by language the ``top`` phrases of 2 to 4 words by
    score, then a, then the phrase's bytes.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line breaks, and those into words at spaces and
    tabs. a is a phrase's number of occurrences within pieces, overlaps included, ``least`` at least; n that of all
    words of the language. Cut after its first k words, a phrase has occurrences l of its first part, r of its rest and
    score floor(2000000 a / (l + r)); the cut of the least score counts, of equal ones the first. A phrase is dropped if
    it stands inside a longer one of as many as inside[0] of inside[1] of its occurrences.

    Pivot partitioning: each word occurrence sends the words beside it that are no rarer, up to three on each side, to
    that word; there the n-grams that hold it are counted, each at the first of its rarest words. Equal fragments are
    added up before they are sent; pivots of more than PART occurrences are counted in parts, whose sums meet later.

    A null language is ``und``, a null text has no words; rows that repeat count each time; a language without phrases,
    or an empty table, gives no rows; other columns are ignored. A text is cut whole, its words being held in memory.
    """
    words = staged(word_counts(docs), "phrase-words")
    numbers, names = numbered(words, least, dictionary)
    found = staged(mined(fragments(docs, numbers), numbers, least), "phrase-found")

    def inner(n: int) -> list[Column]:
        return [F.struct(*_slices(i, i + k - 1)) for k in range(2, n) for i in range(1, n - k + 2)] or [F.lit(None)]

    key = ["v1", "v2", "v3", "v4"]
    shape = "array<struct<v1:bigint,v2:bigint,v3:bigint,v4:bigint>>"
    longer = found.where("w3 >= 0").select("a", F.explode(_of_sizes(inner).cast(shape)).alias("s")).groupBy("s").agg(F.max("a").alias("outer"))
    longer = longer.select(*(F.col(f"s.{v}").alias(w) for v, w in zip(key, WORDS)), "outer")
    kept = found.join(longer, WORDS, "left")
    kept = kept.where(F.coalesce(F.col("outer") * inside[1] < F.col("a") * inside[0], F.lit(True))).drop("outer")

    def cuts(n: int) -> list[Column]:
        return [F.struct(F.lit(k).alias("k"), F.lit(s).alias("side"), *_slices(*span)) for k in range(1, n) for s, span in enumerate(((1, k), (k + 1, n)))]

    asked = kept.select(*WORDS, "a", F.explode(_of_sizes(cuts)).alias("c")).select(*WORDS, "a", "c.*")
    asked = staged(asked.withColumn("own", F.xxhash64(*WORDS)), "phrase-cuts")
    none = F.lit(-1).cast("bigint")
    known = found.select(*(F.col(w).alias(v) for v, w in zip(key, WORDS)), F.col("a").alias("f"), F.lit(None).cast("string").alias("lang"))
    known = known.unionByName(names.select(F.col("w").alias("v1"), none.alias("v2"), none.alias("v3"), none.alias("v4"), "f", "lang"))
    facts = staged(known.join(asked.groupBy(*key).agg(F.count("*").alias("n")), key), "phrase-facts")
    have = joined(asked, facts, key, "own")
    part = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    sides = [part(k, s).alias(f"f{k}{s}") for k in range(1, LONGEST) for s in (0, 1)]
    # The first word is a part of its own, and so its language is known.
    have = have.groupBy(*WORDS, "a").agg(F.max("lang").alias("lang"), *sides)
    score = lambda k: F.expr(f"cast((cast(a as decimal(20, 0)) * 2000000) div (f{k}0 + f{k}1) as bigint)")
    ways = [F.when(F.col(f"f{k}0").isNotNull(), F.struct(score(k).alias("score"), F.lit(k), F.col(f"f{k}0").alias("l"), F.col(f"f{k}1").alias("r"))) for k in range(1, LONGEST)]
    have = have.withColumn("way", F.array_min(F.array_compact(F.array(*ways)))).select("lang", *WORDS, "a", "way.score", "way.l", "way.r")

    # Two steps, so that no task gets all phrases of a language; equal ones at the end stay for the words to decide.
    best = [F.desc("score"), F.desc("a")]
    have = have.withColumn("_b", F.pmod(F.xxhash64(*WORDS), F.lit(64)))
    for by in (["lang", "_b"], ["lang"]):
        have = have.withColumn("_k", F.rank().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("_k") <= top)
    have = staged(have.drop("_b", "_k"), "phrase-best")
    spelt = have.select("lang", *WORDS, F.posexplode(F.array(*WORDS)).alias("i", "w")).where("w >= 0").join(names.select("w", "word"), "w")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"])
    spelt = spelt.groupBy("lang", *WORDS).agg(F.array_join(in_order, " ").alias("phrase"))
    have = have.join(spelt, ["lang", *WORDS])
    have = have.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase")).cast("bigint")).where(F.col("rank") <= top)
    return have.join(words.groupBy("lang").agg(F.sum("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
    WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[.,;:!?
-
]')) piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') ws FROM p),
    f AS (SELECT lang, n len, array_to_string(ws[k:k + n - 1], ' ') ph, count(*) a
          FROM (SELECT lang, ws, n, unnest(range(1, len(ws) - n + 2)) k FROM w, (VALUES (1), (2), (3), (4)) x(n) WHERE len(ws) >= n) GROUP BY ALL),
    t AS (SELECT lang, CAST(sum(a) AS BIGINT) n FROM f WHERE len = 1 GROUP BY lang),
    c AS (SELECT lang, len, ph, string_split(ph, ' ') ws, a FROM f WHERE len > 1 AND a >= 30),
    o AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') ph, max(a) a
          FROM (SELECT lang, ws, len, a, k, unnest(range(1, len - k + 2)) i FROM c, (VALUES (2), (3)) x(k) WHERE k < len) GROUP BY ALL),
    b AS (SELECT c.lang, c.ph, c.a, k, l.a l, r.a r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (l.a + r.a) AS BIGINT) score
          FROM (SELECT *, unnest(range(1, len)) k FROM c) c
          JOIN f l ON l.lang = c.lang AND l.ph = array_to_string(ws[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.ph = array_to_string(ws[k + 1:], ' ')
          LEFT JOIN o ON o.lang = c.lang AND o.ph = c.ph WHERE o.a IS NULL OR 100 * o.a < 80 * c.a),
    s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) x FROM b) WHERE x = 1),
    r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, ph) AS rank, ph AS phrase, a, l, r, score FROM s)
    SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN t USING (lang) WHERE rank <= 2000"""
