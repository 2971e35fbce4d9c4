"""Phrases, ranked search and shards: brute force, the SQL of their queries, and edge cases."""

import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import phrases, queries, search, sharding

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, extra string, rank long, row long, n long, shard string"


def docs(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]), with columns of names that the operators use themselves."""
    full = [(*r, *(("en", "s")[len(r) - 2 :]), "x", 7, 1, 2, "y") for r in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


@pytest.mark.parametrize("name", ["op11_phrase_mining", "op12_ranked_search", "op13_hilbert_sharding"])
def test_same_rows_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


# --- phrases


def naive_phrases(rows, least, top=2000, inside=(80, 100)):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang, counts = lang or "und", f.setdefault(lang or "und", Counter())
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            counts.update(tuple(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        c = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        hidden = {y[i : i + k] for y, a in c.items() for k in range(2, len(y)) for i in range(len(y) - k + 1) if inside[1] * a >= inside[0] * c[y[i : i + k]]}
        scored = []
        for p, a in c.items():
            if p not in hidden:
                s, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def mixed_texts(seed, n):
    rng = random.Random(seed)
    words = ["The", "of", "a", "É", "the x", "b", "cc", "Dd", "e|", "zz"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "; ", "!", "\x0b"]
    return [(i, "".join(rng.choice(words[: 2 + i % 9]) + rng.choice(ends) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None])) for i in range(n)]


@pytest.mark.parametrize("dictionary, part, chunk", [(phrases.DICTIONARY, phrases.PART, phrases.CHUNK), (5, 20, 50), (0, 7, 1)])
def test_phrases_whatever_the_dictionary_and_the_parts(spark, monkeypatch, dictionary, part, chunk):
    monkeypatch.setattr(phrases, "PART", part)
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rows = mixed_texts(1, 60) + [(900, None, "fr"), (901, "", "fr"), (902, "of of of of of of", "en"), (902, "of of of of of of", "en")]
    got = phrases.collocations(docs(spark, rows), least=4, top=40, dictionary=dictionary)
    want = naive_phrases(rows, 4, 40)
    assert want and sorted(map(tuple, got.collect())) == want


def test_phrases_of_nothing_and_of_a_long_text(spark):
    assert phrases.collocations(docs(spark, [(1, None), (2, ""), (3, "once only")])).count() == 0
    assert phrases.collocations(docs(spark, [])).count() == 0
    got = phrases.collocations(docs(spark, [(1, "alpha beta " * 50_000)])).collect()
    assert sorted(map(tuple, got)) == naive_phrases([(1, "alpha beta " * 50_000, "en")], 30)


def test_each_ngram_belongs_to_one_fragment():
    rng = random.Random(4)
    ids = np.array([rng.choice([0, 1, 2, 3, 7, phrases.Numbers.BREAK]) for _ in range(500)], np.int64)
    found = Counter()
    rows, times = phrases.combined(phrases.fragments_of(ids))
    for row, n in zip(rows.tolist(), times.tolist()):
        for left in range(4):
            for right in range(4 - left):
                gram = row[3 - left : 4 + right]
                if len(gram) > 1 and min(gram) >= 0:
                    found[tuple(gram)] += n
    want = Counter(tuple(g) for k in (2, 3, 4) for i in range(500 - k + 1) if phrases.Numbers.BREAK not in (g := ids[i : i + k].tolist()))
    assert found == want


@pytest.mark.parametrize("mix", [phrases._MIX, np.uint64(0)])
def test_counts_when_hashes_collide(monkeypatch, mix):
    monkeypatch.setattr(phrases, "_MIX", mix)
    rng = np.random.default_rng(3)
    rows, n = rng.integers(0, 4, (200, 3)), rng.integers(1, 5, 200)
    want = Counter()
    for r, k in zip(rows.tolist(), n.tolist()):
        want[tuple(r)] += k
    distinct, sums, each = phrases.counted(rows, n)
    assert dict(zip(map(tuple, distinct.tolist()), sums.tolist())) == want
    assert [want[tuple(r)] for r in rows.tolist()] == each.tolist()


def test_words_that_share_a_hash_take_another(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(phrases.F, "xxhash64", lambda *c: F.when(F.length(c[0]) == 5, F.lit(8).cast("bigint")).otherwise(real(*c)) if len(c) == 1 else real(*c))
    rows = [("en", w, 50) for w in ("ab", "cd", "efg")]
    numbers, names = phrases.numbered(spark.createDataFrame(rows, "lang string, word string, f long"), 30, 0)
    assert numbers.salt == b"\0" and len({r.w for r in names.collect()}) == 3


# --- search


def naive_search(rows, items, top=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    bags = [(d, Counter(words(t)), len(words(t))) for d, t in rows if words(t)]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(w for _, b, _ in bags for w in b)
    out = []
    for item, text in items:
        found = []
        for d, bag, size in bags:
            m = 75 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * bag[w] // (1000 * bag[w] + 12 * m)) for w in words(text) if bag[w])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def some_texts(seed, n, vocabulary=60, longest=80):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(vocabulary)] + ["É", "x-Y", "A1"]
    topics = [rng.sample(words, 12) for _ in range(6)]
    return [(n - i, " ".join(rng.choice(topics[i % 6] if rng.random() < 0.8 else words) for _ in range(rng.randrange(longest)))) for i in range(n)]


@pytest.mark.parametrize("shard, rounds", [(search.SHARD_DOCS, search.ROUNDS), (5, (1, 2))])
def test_search_equals_scoring_every_document(spark, monkeypatch, shard, rounds):
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    monkeypatch.setattr(search, "ROUNDS", rounds)
    rows = some_texts(2, 400) + [(900, None), (901, ""), (902, "- -"), (None, "w1 w2 w3"), (None, "w1 w2 w3")] + [(k % 40, "w1 w2 w1") for k in range(80)]
    items = some_texts(3, 12, longest=20) + [(70, "w1 w1 w2"), (70, "w1 w1 w2"), (71, None), (72, "unheard"), (73, "")]
    table = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, score string")
    got = search.ranked_search(docs(spark, rows), table, top=7)
    assert sorted(map(tuple, got.collect()), key=repr) == naive_search(rows, items, 7)


def test_search_in_several_blocks_and_over_nothing(spark, monkeypatch):
    rows, items = some_texts(5, 60), some_texts(6, 9, longest=15)
    table = spark.createDataFrame(items, "item_id long, text string")
    assert search.ranked_search(docs(spark, []), table).count() == 0
    assert search.ranked_search(docs(spark, [(1, None)]), table).count() == 0
    assert search.ranked_search(docs(spark, rows), table.limit(0)).count() == 0
    monkeypatch.setattr(search, "BLOCK_BYTES", 150)
    assert sorted(map(tuple, search.ranked_search(docs(spark, rows), table).collect()), key=repr) == naive_search(rows, items)


def test_bisection_parts_topics_and_balances():
    rng = random.Random(1)
    docs_ = [np.array(sorted(set(rng.choices(range(0, 40) if k % 2 else range(40, 80), k=12))), np.int64) for k in range(200)]
    gains, cuts = search.bisected(docs_, 80, 1)
    flat, owner = np.concatenate(docs_), np.repeat(np.arange(200), [len(d) for d in docs_])
    cluster = search.sorted_down(gains, cuts, flat, owner, 200, 1)
    assert len(set(cluster[::2])) == 1 and len(set(cluster[1::2])) == 1 and cluster[0] != cluster[1]


def test_bounds_rule_out_shards_of_other_topics(spark):
    """Of two vocabularies without a common word, no shard of the other one is promising."""
    rows = [(k, f"a{k % 9} a{k % 7} a{k % 5}" if k % 2 else f"b{k % 9} b{k % 7} b{k % 5}") for k in range(400)]
    q = search.Queries(["a1 a2 a3", "b1 b2 b3"])
    counts = search.counted(docs(spark, rows), q)
    q.weigh(np.ones(len(q.number), np.int64))
    sample = [np.array(r.terms, np.int64) for r in counts.where("size(terms) > 0").select("terms").distinct().collect()]
    index = search.clustered_index(counts, 400, 1200, search.bisected(sample, len(q.number), 1), 1)
    met = search.promising(index, spark.sparkContext.broadcast(q), np.ones(2, np.int64), np.zeros((0, 2), np.int64), 100)
    assert {c for c, _, k in met if k == 0}.isdisjoint({c for c, _, k in met if k == 1})


# --- shards


def test_curve_goes_through_neighbours(spark):
    for dims, bits in ((1, 3), (2, 3), (3, 2)):
        side = 1 << bits
        cells = spark.range(side**dims).select(*(F.expr(f"cast((id div {side**k}) % {side} as int)").alias(f"c{k}") for k in range(dims)))
        rows = cells.withColumn("h", sharding.hilbert_index([F.col(f"c{k}") for k in range(dims)], bits)).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(side**dims))
        assert all(sum(abs(a[k] - b[k]) for k in range(dims)) == 1 for a, b in zip(rows, rows[1:]))


def shard_rows(seed):
    rng = random.Random(seed)
    rows = [(k, "x" * rng.randrange(900), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None])) for k in range(400)]
    return rows + [(1000 + k, "copy of a text " * 9, "en", f"s{k % 5}") for k in range(300)] + [(7, None, None, None), (None, "", "en", "s1"), (5, "again", "en", "s1"), (5, "again", "en", "s1")]


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards_obey_their_law(spark, law):
    rows = shard_rows(3)
    got = sharding.shards_of_documents(docs(spark, rows), law=law).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    by = {s: [r for r in got if r.shard == s] for s in range(8)}
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        sums, each = [sum(r.size for r in x) for x in by.values()], sum(r.size for r in got) / 8
        assert max(abs(s - each) for s in sums) <= sharding.WHOLE * each + 901
    again = sharding.shards_of_documents(docs(spark, rows[::-1]).repartition(7), law=law)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))


def test_groups_of_equal_texts_stay_together_unless_they_are_large(spark):
    rows = [(k, f"text {k // 4} " * (k // 4 % 30 + 1), "en", f"s{k}") for k in range(4000)]
    where = {}
    for r in sharding.shards_of_documents(docs(spark, rows)).collect():
        where.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert len(where) == 1000 and all(len(s) == 1 for s in where.values())
    one = sharding.shards_of_documents(docs(spark, [(k, "the same") for k in range(800)])).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in one) == [100] * 8


def test_shards_of_few_documents(spark):
    assert sharding.shards_of_documents(docs(spark, [])).count() == 0
    assert [r.slot for r in sharding.shards_of_documents(docs(spark, [(1, None)])).collect()] == [0]
    with pytest.raises(ValueError):
        sharding.hilbert_places(docs(spark, []), law="key")


def test_written_shards_keep_everything_and_prune(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, "y" * rng.randrange(2000) + str(k), "en", f"s{rng.randrange(40):02d}") for k in range(4000)]
    table = docs(spark, rows)
    out = sharding.write_shards(table, str(tmp_path / "out"), file_rows=100, dims=("source",))
    assert Counter(map(tuple, out.select(*[c for c in DOCS.replace(" long", "").replace(" string", "").split(", ") if c != "shard"]).collect())) == Counter((*r, "x", 7, 1, 2) for r in rows)
    ends = out.groupBy(F.input_file_name()).agg(F.min("source"), F.max("source"), F.min(F.length("text")), F.max(F.length("text"))).collect()
    met = [sum(a <= s <= b and c <= n <= d for _, a, b, c, d in ends) / len(ends) for s in ("s05", "s33") for n in (100, 1700)]
    assert len(ends) >= 32 and max(met) < 0.35
