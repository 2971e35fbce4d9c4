"""Near-duplicates, mixing, decontamination and lines against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hushframe.llm import decontaminate, line_dedup, mixing, shared, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    """Rows of (doc_id, text[, source])."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS)


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_components_of_chains_rings_and_stars(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    rng.shuffle(links)
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert got == roots({n for x in links for n in x}, links)
    assert shared.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_components_of_few_links_need_no_tables_of_hubs(spark, monkeypatch):
    made = []
    monkeypatch.setattr(shared, "staged", lambda df, label, f=shared.staged: made.append(df.columns) or f(df, label))
    links = spark.createDataFrame([(0, k) for k in range(1, 9)] + [(k, k + 1) for k in range(20, 30)], "a long, b long")
    few = {tuple(r) for r in shared.components(links, "t").collect()}
    assert ["b"] not in made
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in shared.components(links, "t").collect()} == few == {(k, 0) for k in range(9)} | {(k, 20) for k in range(20, 31)}
    assert ["b"] in made


def test_lines_are_measured_once_for_all_signatures(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(line_dedup, "staged", lambda df, label, f=line_dedup.staged: plans.append(df) or f(df, label))
    lines = spark.createDataFrame([(1, "a line of over thirty letters here"), (2, "a line of over thirty letters hear")], "node long, line string")
    assert [tuple(r) for r in line_dedup.edit_links(lines).collect()] == [(1, 2)]
    signed = next(df for df in plans if "l0" in df.columns)._jdf.queryExecution().optimizedPlan().toString()
    # One more for each side of the union, where short lines are left out.
    assert signed.count("length(line") <= 8, signed.count("length(line")
    counted = spark.createDataFrame([("banana tree, äöü eels",)], "line string").select(line_dedup.sketch(F.col("line"))).first()[0]
    assert [counted >> 2 * k & 3 for k in range(len(line_dedup.LETTERS))] == ["banana tree, äöü eels".count(c) % 4 for c in line_dedup.LETTERS]


def naive_print(text):
    w = text.encode().lower().split() if text else []
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    own = [(r.doc_id, r.text) for r in table.collect()]
    own += [(9001, None), (9002, " \n"), (9003, "One two"), (9003, "one TWO"), (9004, "a" * 50000), (9005, own[3][1])]
    got = simhash.simhash_classes(docs(spark, own).withColumn("fp", F.lit("clash"))).collect()
    prints = [(i, naive_print(t)) for i, t in own]
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((i, f"{p:016x}") for i, p in prints)
    distinct = sorted({p for _, p in prints})
    a = np.array(distinct, np.uint64)
    i, j = np.where(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 2, 1))
    root = roots(distinct, [(distinct[x], distinct[y]) for x, y in zip(i, j)])
    least = {}
    for d, p in prints:
        least[root[p]] = min(d, least.get(root[p], d))
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((d, least[root[p]]) for d, p in prints)
    assert simhash.simhash_classes(docs(spark, [])).count() == 0


@pytest.mark.parametrize("budget", [2, 5, 8])
def test_trie_join_finds_all_pairs(budget):
    rng = np.random.default_rng(budget)
    values = [int(x) for x in rng.integers(0, 2**63, 200, dtype=np.uint64)]
    for x in values[:40]:
        for _ in range(4):
            y = x
            for b in rng.choice(64, rng.integers(1, 11), replace=False):
                y ^= 1 << int(b)
            values.append(y)
    values = np.unique(np.array(values, np.uint64))
    got = set()
    for by, allowed in simhash.orders(budget):
        turned = np.sort(simhash.rotated(values, by))
        back = simhash.rotated(turned, (64 - by) % 64)
        for i, j in simhash.near_pairs(turned, turned, True, allowed, 0, 0):
            got |= {(min(p, q), max(p, q)) for p, q in zip(back[i].tolist(), back[j].tolist())}
    i, j = np.where(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= budget, 1))
    assert got == {(int(values[x]), int(values[y])) for x, y in zip(i, j)}


def edited(words, rng, n):
    w = list(words)
    for k in rng.sample(range(len(w)), n):
        w[k] = "x" + str(rng.randrange(10**6))
    return " ".join(w)


def test_near_duplicates_leave_one_of_each_group(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    originals = [[word() for _ in range(150)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(originals)]
    rows += [(100 + 10 * i + k, edited(originals[i], rng, 2)) for i in range(10) for k in range(4)]
    rows += [(500, rows[20][1]), (501, None), (502, None), (503, ""), (504, "")]
    kept = {r.doc_id for r in simhash.without_near_duplicates(docs(spark, rows)).collect()}
    assert kept == set(range(30)) | {501, 503}


def test_near_duplicates_edges(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(5, text), (5, text), (None, text), (3, None), (4, None), (7, ""), (8, ""), (9, "alone in here"), (None, "nobody")]
    d = docs(spark, rows).withColumn("row", F.lit(1)).withColumn("node", F.lit(2)).withColumn("there", F.lit(True)).withColumn("root", F.lit("x"))
    out = simhash.without_near_duplicates(d)
    assert out.columns == d.columns
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(["5", "3", "7", "9", "None"])
    assert simhash.without_near_duplicates(d.limit(0)).count() == 0


def families_without_originals(rng, families=12, pairs=9):
    """Texts of two edits each: two of a pair share one, so that they are at 0.81, and all others at 0.76 or less."""
    rows = []
    for f in range(families):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(150)]
        places = rng.sample(range(4, 144, 5), 3 * pairs)
        for p in range(pairs):
            at = places[3 * p : 3 * p + 3]
            for k in (1, 2):
                w = list(words)
                w[at[0]], w[at[k]] = f"s{f}x{p}", f"o{f}x{p}x{k}"
                rows.append((1000 * f + 10 * p + k, " ".join(w)))
    rng.shuffle(rows)
    return rows


def brute_classes(rows):
    """Classes of candidates within 8 bits in one of the fingerprints and of a Jaccard index of 0.8 or more."""
    grams = [set(simhash.shingles(simhash.fold_ascii(t), 5)) for _, t in rows]
    prints = [[simhash.fingerprint_of(t, 2, s, distinct=True) for s in (42, 43)] for _, t in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if any((x ^ y).bit_count() <= 8 for x, y in zip(prints[i], prints[j])):
                if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                    links.append((rows[i][0], rows[j][0]))
    return roots([i for i, _ in rows], links)


@pytest.mark.parametrize("block", [simhash.BLOCK_TEXTS, 7])
def test_near_duplicates_in_groups_whose_original_is_missing(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
    rows = families_without_originals(random.Random(12))
    want = brute_classes(rows)
    assert len(set(want.values())) < 0.6 * len(rows)
    kept = {r.doc_id for r in simhash.without_near_duplicates(docs(spark, rows)).collect()}
    assert kept == set(want.values())


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), f"s{i % 5}" if i % 7 else None) for i in range(600)]
    rows += [(700, None, "s1"), (701, "w " * 30000, "big")]
    got = mixing.pareto_mix(docs(spark, rows)).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    assert {r.doc_id: r["size"] for r in got} == size
    total = {}
    for i, _, s in rows:
        total[s] = total.get(s, 0) + size[i]
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weight, cap = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, {s: 2.0 * total[s] for s in order}
    want, left, free = {}, 1.5 * sum(total.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > cap[s]}
        if not above:
            break
        want |= {s: cap[s] for s in above}
        left -= sum(cap[s] for s in above)
        free -= above
    want |= {s: weight[s] * level for s in free}
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == total[s] for r in mine)
        most = max(r["size"] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(1, min(most, 0.02 * want[s] + (most if len(mine) < 5 else 0)))
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    again = mixing.pareto_mix(docs(spark, rows[::-1])).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.pareto_mix(docs(spark, [])).count() == 0
    out = mixing.mixed(docs(spark, rows))
    assert set(out.columns) == {*DOCS.replace(" long", "").replace(" string", "").split(", "), "copies", "taken"}


def test_mix_draws_by_rank_with_unequal_chances(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice((1, 4, 30, 200))), f"s{i % 3}") for i in range(900)]
    got = mixing.pareto_mix(docs(spark, rows), importance=mixing.by_length(), share=0.9).collect()
    for s in ("s0", "s1", "s2"):
        mine = [r for r in got if r.source == s]
        whole = int(mine[0].target // mine[0].source_size)
        rest = mine[0].target - whole * mine[0].source_size
        assert abs(sum(r.chance * r["size"] for r in mine) - rest) < 1e-6 * mine[0].source_size
        open_ = [r for r in mine if r.chance < 1]
        ratios = [r.chance / np.log1p(r["size"]) for r in open_]
        assert max(ratios) - min(ratios) < 1e-9 and len({round(r.chance, 9) for r in mine}) > 1
        odds = lambda p: p / (1 - p) if p < 1 else 1e300
        left, want = rest, set()
        ranked = sorted(mine, key=lambda r: odds(r.u) / odds(r.chance))
        for r in ranked:
            if r["size"] > left:
                break
            left -= r["size"]
            want.add(r.doc_id)
        fits = [(abs(left - r["size"]), r.doc_id) for r in mine if r.doc_id not in want and abs(left - r["size"]) < left]
        drawn = {r.doc_id for r in mine if r.copies > whole}
        assert want <= drawn and len(drawn - want) == (1 if fits else 0)
        assert all(abs(left - r["size"]) == min(fits)[0] for r in mine if r.doc_id in drawn - want)


def test_mix_of_repeated_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 64)  # large groups of equal rows are numbered by several tasks
    for one in (7, None):
        rows = [(one, "w " * 10, "a")] * 1000 + [(9000 + i, "w " * 10, "b") for i in range(500)]
        got = mixing.pareto_mix(docs(spark, rows)).collect()
        assert len(got) == 1500
        for s in "ab":
            mine = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 10 and max(r.copies for r in mine) <= 2
        out = mixing.mixed(docs(spark, rows).withColumn("row", F.lit(1)).withColumn("copies", F.lit(5))).collect()
        assert sum(r.taken for r in out) == sum(r.taken for r in got) and [r.row for r in out if r.doc_id == one] == [1]
    assert mixing.mixed(docs(spark, [])).count() == 0 and mixing.mixed(docs(spark, [(1, None), (None, "")])).count() == 0


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive_hits(rows, items):
    windows = {}
    for i, t in items:
        w = WORDS.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= x
        names = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [decontaminate.BLOCK_BYTES, 400])
def test_contamination(spark, limit):
    ten = "Alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu"
    items = [(1, ten), (2, "short item"), (3, None), (4, "!!"), (11, "beta gamma delta épsilon zeta eta theta iota kappa lambda"), (5, "w " * 60)]
    rows = [(1, "x " + ten.upper().replace("É", "é") + " y"), (2, "a SHORT, item! here"), (3, None), (4, ""), (5, ten[:40]), (6, "w " * 5000), (7, ten + " " + ten), (7, ten)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = decontaminate.benchmark_hits(docs(spark, rows).withColumn("item_id", F.lit(0)), bench, block_bytes=limit)
    items_of = F.array_join("_found.items", ",")
    got = hits.select("row.doc_id", "_found.n_words", decontaminate.hit_words(F.col("_found.spans")), F.size("_found.items"), F.sha2(items_of, 256), decontaminate.hit_words(F.col("_found.spans")) > 0)
    assert sorted(map(tuple, got.collect()), key=repr) == naive_hits(rows, items)
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0
    assert all(not r.contaminated for r in decontaminate.contamination(docs(spark, rows), bench.limit(0)).collect())


def test_decontamination_is_one_python_pass(spark):
    """The pipeline: each function that runs beside another keeps workers of its own in an executor's memory."""
    rows = [(k, t) for k, t in enumerate([None, "", "short", f"before {' '.join(f'w{i}' for i in range(12))} and a good many words after it", "w1 w2 w3"])]
    bench = spark.createDataFrame([("x", " ".join(f"w{i}" for i in range(10))), ("y", "w4 w5 w6 w7 w8 w9 w10 w11 and a")], "item_id string, text string")
    d = docs(spark, rows)
    plan = decontaminate.decontaminated(d, bench)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan
    assert decontaminate.contamination(d, bench)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    whole, parts = (
        {r.doc_id: r.kept for r in decontaminate.benchmark_hits(d, bench, cut=True, **limit).select("row.doc_id", "_found.kept").collect()}
        for limit in ({}, {"block_bytes": 20})
    )
    assert whole == parts == {0: None, 1: None, 2: None, 3: "before good many words after it", 4: None}


def test_decontaminated(spark):
    ten = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, ten)], "item_id long, text string")
    keep = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(1, f"{keep} {ten}, {keep}"), (2, ten), (3, keep), (4, None)]
    d = docs(spark, rows).withColumn("row", F.lit(1)).withColumn("_found", F.lit(2)).withColumn("items", F.lit(3))
    out = decontaminate.decontaminated(d, bench)
    assert out.columns == d.columns and decontaminate.decontaminated(docs(spark, []), bench).count() == 0
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: f"{keep} {keep}", 3: keep, 4: None}


def test_banded_distance_and_screen(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        a = [rng.choice("abcé ") for _ in range(rng.choice((0, 3, 20, 90)))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k, at = rng.randint(0, 2), rng.randint(0, len(b))
            if k == 0:
                b.insert(at, rng.choice("abx"))
            elif b:
                b[min(at, len(b) - 1) : min(at, len(b) - 1) + 1] = [] if k == 1 else ["y"]
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2, 3):
        for r in df.select("a", "b", line_dedup.edit_distance_within(F.col("a"), F.col("b"), k).alias("d"), line_dedup.may_be_within(F.col("a"), F.col("b"), k).alias("m")).collect():
            want = levenshtein(r.a, r.b)
            assert min(r.d, k + 1) == min(want, k + 1)
            assert r.m or want > k


def test_edits_in_the_middle_of_long_lines_link(spark):
    rng = random.Random(11)
    line = lambda n: "".join(rng.choice("abcdefgh ijé") for _ in range(n))
    change = lambda s, *places: "".join("X" if k in places else c for k, c in enumerate(s))
    ten, nine, seventeen, twenty, most = map(line, (10000, 9000, 17000, 20000, 150000))
    pairs = [(ten, change(ten, 5000), 1), (twenty, change(twenty, 10000), 1), (seventeen, change(seventeen, 8500), 1)]
    pairs += [(nine, change(nine, 8300, 8900), 2), (twenty, twenty[:9000] + twenty[9001:11000] + "X" + twenty[11000:], 2)]
    pairs += [(twenty, change(twenty, 9000, 10000, 11000), 3), (most, change(most, 70000, 70100), 2)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    may, apart = (f(F.col("a"), F.col("b"), 2) for f in (line_dedup.may_be_within, line_dedup.edit_distance_within))
    for r in df.select("want", may.alias("may"), apart.alias("d")).collect():
        assert min(r.d, 3) == r.want and (r.may or r.want > 2)
    lines = df.where("length(a) < 100000").selectExpr("inline(array(struct(a AS line), struct(b AS line)))").distinct()
    lines = lines.withColumn("node", F.xxhash64("line"))
    node = {r.line: r.node for r in lines.collect()}
    want = {tuple(sorted((node[a], node[b]))) for a, b, d in pairs if d <= 2 and len(a) < 100000}
    got = {(r.a, r.b) for r in line_dedup.edit_links(lines).collect()}
    assert want <= got and all(levenshtein_ends(*(k for k, v in node.items() if v in x)) <= 2 for x in got)


def test_short_lines_are_duplicates_where_equal(spark):
    least = "x2345678901234567890 end."  # 25 code points
    rows = [(1, "Yes.\n \nYes.\nYet."), (2, "Yes.\n \nNo."), (3, least), (4, least[1:]), (5, least[3:]), (6, least[2:])]
    out = {r.doc_id: (r.n_removed, r.n_links, r.kept_in) for r in line_dedup.line_duplicates_of_documents(docs(spark, rows)).collect()}
    assert out == {1: (1, 0, [1]), 2: (1, 0, [1]), 3: (0, 2, []), 4: (1, 1, [3]), 5: (0, 0, []), 6: (1, 1, [3])}
    kept = {r.doc_id: r.text for r in line_dedup.without_duplicate_lines(docs(spark, rows)).collect()}
    assert kept == {1: "Yes.\n \nYet.", 2: " \nNo.", 3: least, 5: least[3:]}


def levenshtein_ends(a, b):
    """The distance of what is left once the whole common beginning and end are cut off."""
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[k:], b[k:]
    k = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return levenshtein(a[: len(a) - k], b[: len(b) - k])


def test_line_links_and_duplicates(spark):
    rng = random.Random(8)
    line = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    lines = [line(rng.randint(25, 60)) for _ in range(60)]
    base = line(80)
    for _ in range(60):  # versions of a line that share whole segments, so that index lists get long
        v = list(base)
        for _ in range(rng.randint(0, 4)):
            v[rng.randrange(80)] = rng.choice("xyz")
        lines.append("".join(v))
    rows = [(i, "\n".join([rng.choice(lines), "short", rng.choice(lines)])) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, rows[3][1]), (903, rows[3][1]), (904, line(20000))]
    d = docs(spark, rows)
    linked = line_dedup.lines_of(d).select("node", "line").distinct().collect()
    got = {(r.a, r.b) for r in line_dedup.edit_links(d and line_dedup.lines_of(d).select("node", "line")).collect()}
    want = {(min(x.node, y.node), max(x.node, y.node)) for i, x in enumerate(linked) for y in linked[:i] if abs(len(x.line) - len(y.line)) <= 2 and levenshtein(x.line, y.line) <= 2}
    assert got == want
    node = {x.line: x.node for x in linked}
    root = roots(node.values(), want)
    first, removed = {}, {}
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        for at, x in enumerate((t or "").split("\n")):
            if len(x) >= line_dedup.LEAST and first.setdefault(root[node[x]], (i, at)) != (i, at):
                removed.setdefault(i, []).append(at)
    out = line_dedup.line_duplicates_of_documents(d).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.n_removed for r in out if r.n_removed} == {i: len(x) for i, x in removed.items()}
    kept = {r.doc_id: r.text for r in line_dedup.without_duplicate_lines(d).collect()}
    for i, t in rows:
        rest = None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if at not in removed.get(i, []))
        assert (i not in kept) if removed.get(i) and not rest.strip() else kept[i] == rest
    assert line_dedup.line_duplicates_of_documents(docs(spark, [])).count() == 0
