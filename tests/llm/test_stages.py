"""Every stage of the pipeline, on what the stage before it kept, against a plain version of it."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from hushframe.llm import quality
from hushframe.llm.shared import staged
from tests.llm.test_pairs import LOWER, WORDS, edited, families_without_originals, levenshtein, roots

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Some of the small documents with labels, families of near copies whose original is missing, exact copies, shared
    and edited lines, benchmark passages, and empty texts; benchmark and labels beside them."""
    rng = random.Random(21)
    own = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 900").orderBy("doc_id").limit(90).collect()
    rows = [(r.doc_id, r.text, r.source) for r in own]
    rows += [(10_000 + i, t, "fam") for i, t in families_without_originals(rng, 2, 4)]
    rows += [(20_000 + k, rows[k % 7][1], "copies") for k in range(20)]
    words = rows[3][1].split()
    rows += [(21_000 + k, edited(words, rng, 1), "copies") for k in range(3)] if len(words) > 80 else []
    line = "This line of the licence stands in many of the documents, word for word."
    rows += [(30_000 + k, f"{' '.join(rng.sample(words, min(30, len(words))))} {k}\n{line if k % 2 else line.replace('many', 'mamy')}", "lines") for k in range(12)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(6).collect()]
    rows += [(40_000 + k, f"{rows[10 + k][1]}\n{t}\nand on it goes for {k} more", "bench") for k, (_, t) in enumerate(items)]
    rows += [(41_000, items[0][1], "bench"), (50_000, "", "odd"), (50_001, None, "odd"), (50_002, " \n ", None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    full = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def plain_lines(rows, edits=2, least=25):
    """Lines that are equal, or within the edits where the longer has the least length, are one class, of which the first
    by document and place stays."""
    places = [(i, k, s) for i, t in rows for k, s in enumerate((t or "").split("\n")) if s.strip()]
    lines = sorted({s for *_, s in places}, key=len)
    number, bags, links = {s: n for n, s in enumerate(lines)}, [Counter(s) for s in lines], []
    for b in range(len(lines)):
        for a in range(b - 1, -1, -1):
            if len(lines[b]) - len(lines[a]) > edits:
                break
            far = max((bags[a] - bags[b]).total(), (bags[b] - bags[a]).total())
            if len(lines[b]) >= least and far <= edits and levenshtein(lines[a], lines[b]) <= edits:
                links.append((a, b))
    cls = roots(range(len(lines)), links)
    first = {}
    for i, k, s in sorted(places):
        first.setdefault(cls[number[s]], (i, k))
    gone = {(i, k) for i, k, s in places if first[cls[number[s]]] != (i, k)}
    out = {}
    for i, t in rows:
        removed = {k for d, k in gone if d == i}
        if removed:
            t = "\n".join(s for k, s in enumerate(t.split("\n")) if k not in removed)
            if not t.strip():
                continue
        out[i] = t
    return out


def plain_near(rows, width=5, similarity=0.8):
    """The least document of each group of texts that are equal, or linked by their Jaccard index."""
    split = {i: (t or "").encode().lower().split() for i, t in rows}
    grams = {i: {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set() for i, w in split.items()}
    links, ids = [], [i for i, _ in rows]
    text = dict(rows)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = grams[i] | grams[j]
            if text[i] == text[j] or (grams[i] and grams[j] and len(grams[i] & grams[j]) >= similarity * len(both)):
                links.append((i, j))
    return set(roots(ids, links).values())


def plain_clean(rows, items, window=10, most=0.5):
    """By document the words that stay, without documents of which more than half is hit."""
    windows = set()
    for _, t in items:
        w = WORDS.findall((t or "").translate(LOWER))
        windows |= {tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1))} if w else set()
    out = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        hit = set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if len(hit) <= most * len(w):
            out[i] = [x for k, x in enumerate(w) if k not in hit]
    return out


def test_stages_against_plain_versions(spark, fixture):
    docs = spark.read.parquet(f"{fixture}/documents.parquet")
    labels = spark.read.parquet(f"{fixture}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{fixture}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)

    def run(name, docs):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = staged(stages[name](spark, docs, fixture), "t")
        return before, after, {r.doc_id: r.text for r in after.collect()}

    before, docs, got = run("quality_classifier", docs)
    scores = {r.doc_id: r.score for r in quality.quality_of_documents(spark.read.parquet(f"{fixture}/documents.parquet"), labels).collect()}
    assert got == {i: t for i, t in before if scores[i] >= 0.3} and docs.columns == COLUMNS and len(got) > 60

    before, docs, got = run("line_dedup", docs)
    assert got == plain_lines(before) and docs.columns == COLUMNS and len(got) < len(before)
    assert all(r.n_chars == len(r.text or "") for r in docs.collect() if got[r.doc_id] != dict(before)[r.doc_id])

    before, docs, got = run("simhash_near_dedup", docs)
    assert got == {i: t for i, t in before if i in plain_near(before)} and docs.columns == COLUMNS and len(got) < len(before)

    before, docs, got = run("benchmark_decontamination", docs)
    want = plain_clean(before, items)
    assert {i: WORDS.findall((t or "").translate(LOWER)) for i, t in got.items()} == want and docs.columns == COLUMNS
    assert all(t == dict(before)[i] for i, t in got.items() if len(want[i]) == len(WORDS.findall((t or "").translate(LOWER))) and want[i] == WORDS.findall((dict(before)[i] or "").translate(LOWER)))
    assert any(got.get(i) != t for i, t in before)

    before, mix, got = run("mix_sources", docs)
    size = {i: len((t or "").encode().split()) for i, t in before}
    rows = mix.collect()
    assert set(got) <= set(size) and all(got[i] == dict(before)[i] for i in got)
    assert all(r.copies in (1, 2) and r.taken == r.copies * size[r.doc_id] for r in rows)
    by = {r.doc_id: r.source for r in docs.collect()}
    sizes = Counter()
    for i, n in size.items():
        sizes[by[i]] += n
    assert abs(sum(r.taken for r in rows) - min(1.5 * sum(sizes.values()), 2 * sum(sizes.values()))) <= sum(max(n for i, n in size.items() if by[i] == s) for s in sizes)
