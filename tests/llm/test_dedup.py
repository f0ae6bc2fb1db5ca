from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm.common import connected_components, marked, split_join
from tidemark.llm.minhash_dedup import intersections, near_duplicates
from tidemark.llm.substring_dedup import FingerprintLog, cut_spans, substring_dedup, versioned
from tidemark.llm.superminhash import signatures

SCHEMA = "doc_id long, text string"


def corpus(seed: int, n: int = 60) -> list[tuple]:
    """Originals, edited and exact copies, shared passages, repeats, odd and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(3)]
    docs: list[tuple] = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.25 and docs:
            w = brute.words(rng.choice(docs)[1])
            for _ in range(rng.randint(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = "  ".join(w)
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 5, 20, 80, 200])))
            if kind > 0.7:
                text = f"{text}\n{rng.choice(shared)}\t{text[:50]}"
        docs.append((i * 3, text))
    docs += [(1000, None), (1001, ""), (1002, "   é \x0b ü"), (1003, docs[5][1]), (1004, docs[5][1].upper())]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_equals_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    out = substring_dedup(df, batches=3, window=12, gram=4, fanout=2)
    got = {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in out.withColumn("sha", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()}
    assert got == brute.substring_dedup(docs, 12)
    assert sum(x[1] for x in got.values()) > 0


def test_log_compacts_and_removes_against_history(spark):
    text = " ".join(f"a{k}" for k in range(40))
    log = FingerprintLog(spark, window=10, gram=3, fanout=2)
    removed = []
    for k in range(4):
        own = versioned(spark.createDataFrame([(k, f"x{k} {text} y{k}")], SCHEMA))
        removed.append(cut_spans(own, log.add(own)).first().n_removed)
    assert removed == [0, 40, 40, 40]
    assert [level for level, _ in log.runs] == [2]  # four runs became two, and these one


def test_substring_dedup_cuts_every_place_of_a_block_in_its_first_document(spark):
    """A block that its smallest holder has twice, of which only some windows are in a smaller document."""
    docs, versions = [], {}
    for k in range(12):
        part = {name: " ".join(f"{name}{k}.{i}" for i in range(n)) for name, n in (("a", 20), ("b", 20), ("p", 15 + k), ("x", 25), ("y", 25), ("z", 9))}
        a, b, p, x, y, z = (part[name] for name in "abpxyz")
        docs += [(10 * k, f"{a} {p} {b}"), (10 * k + 1, f"{x} {p} {y} {x} {p} {y}"), (10 * k + 2, f"{x} {p} {y}")]
        versions[10 * k + 2] = f"{z} {x} {p} {y} {z} {x} {p} {y}"
        docs += [(10 * k + 3, f"{b} {a} {p} {z}")]
    rows = docs + sorted(versions.items())
    for shown in (docs, rows):
        out = substring_dedup(spark.createDataFrame(shown, SCHEMA), batches=1, window=12, gram=4)
        got = sorted((r.doc_id, r.n_words, r.n_removed) for r in out.collect())
        # brute.substring_dedup gives the last row of each doc_id: once the first text, once the second.
        want = {(i, *v[:2]) for i, v in brute.substring_dedup(shown, 12).items()}
        if shown is rows:
            want |= {(i, *v[:2]) for i, v in brute.substring_dedup(sorted(versions.items()) + docs, 12).items()}
        assert got == sorted(want)


def thue_morse(a: str, b: str, doublings: int) -> tuple[list[str], list[str]]:
    """A sequence and its complement, which collide in any polynomial hash modulo a power of two."""
    one, two = [a], [b]
    for _ in range(doublings):
        one, two = one + two, two + one
    return one, two


def test_repeating_patterns_do_not_collide(spark):
    """Words of 1024 letters, and 1024 words, that polynomials modulo 2**64 can't tell apart."""
    (a, b), rest = ("".join(x) for x in thue_morse("a", "b", 10)), " ".join(f"r{k}" for k in range(49))
    x, y = (" ".join(t) for t in thue_morse("tick", "tock", 10))
    docs = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, x), (4, y), (5, a), (6, b)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in substring_dedup(df, batches=1).withColumn("sha", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()}
    assert got == brute.substring_dedup(docs, 50) and got[2][1] == 0
    groups = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert groups == brute.near_duplicates(docs) and groups[6] == (1, 6)


def test_very_long_texts(spark):
    """A text of some megabytes is one row like any other."""
    rng = random.Random(9)
    long = " ".join(f"n{rng.randrange(10**7)}" for _ in range(150_000))
    passage = " ".join(long.split()[70_000:70_120])
    docs = [(1, "short one"), (2, long), (3, f"before {passage} after"), (4, long + " end"), (5, "q" * 2_000_000)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(df).collect()}
    assert got == {i: x[:2] for i, x in brute.substring_dedup(docs, 50).items()} and got[3] == (122, 120)
    roots = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert roots[4][1] == 2 and roots[2][0] == 149_996 and roots[5] == (1, 5)


def test_presence_maps_and_split_joins(spark):
    """Rows without a partner are told apart by the map; joins are those of Spark, however full the map is."""
    big = spark.createDataFrame([(i % 300 if i % 7 else None, i) for i in range(600)], "k long, v long")
    small = spark.createDataFrame([(i, f"x{i}") for i in range(0, 300, 3)], "k long, w string")
    for bits in (64, 1 << 20):
        rows = marked(big, small, ["k"], bits=bits).collect()
        assert all(r._maybe for r in rows if r.k is not None and r.k % 3 == 0) and len(rows) == 600
    assert sum(r._maybe for r in rows) < 250
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = split_join(big, small, ["k"], how), big.join(small, "k", how)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        assert split_join(big, small.limit(0), ["k"], how).count() == big.join(small.limit(0), "k", how).count()


def test_substring_dedup_edge_cases(spark):
    text = " ".join(f"b{k}" for k in range(60))
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, text), (5, text), (5, text), (7, text), (7, "short"), (9, None)]
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA).withColumn("start", F.lit(1)).withColumn("spans", F.lit("x"))).collect()
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed) for r in got)
    assert found == [(-1, 60, 0), (5, 60, 0), (5, 60, 0), (7, 1, 0), (7, 60, 60), (9, 0, 0)]


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates_equal_brute_force(spark, seed):
    docs = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}
    want = brute.near_duplicates(docs)
    assert got == want
    assert len({c for _, c in want.values()}) < len(docs)


def test_large_group_of_near_copies(spark):
    """More copies than a block holds, at distances around the threshold."""
    rng = random.Random(8)
    base = [f"v{k}" for k in range(150)]
    docs = []
    for i in range(220):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == brute.near_duplicates(docs)


def test_near_duplicates_edge_cases(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "A B C D E F"), (8, "one two"), (9, "ONE  two"), (10, ""), (11, None)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit(1)).withColumn("n", F.lit(2))).collect()
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=lambda x: (x[0] is not None, x))
    assert found == [(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (8, 1, 8, True), (9, 1, 8, False), (10, 0, 10, True), (11, 0, 11, True)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85):
        n, errors = 300, []
        for _ in range(20):
            common = rng.integers(1 << 63, size=int(n * share), dtype=np.uint64)
            rest = rng.integers(1 << 63, size=(2, (n - len(common)) // 2), dtype=np.uint64)
            a, b = np.concatenate([common, rest[0]]), np.concatenate([common, rest[1]])
            s = signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 144)
            errors.append((s[0] == s[1]).mean() - len(common) / (len(common) + 2 * rest.shape[1]))
        assert abs(np.mean(errors)) < 0.03
    few = signatures(np.array([5, 9], np.uint64), np.array([0, 2]), 3, 144)
    assert (few[0] != ~np.uint64(0)).all() and (few[1] == ~np.uint64(0)).all()


def test_intersections_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, size=rng.integers(0, 200), dtype=np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    assert intersections(sets[:4], sets[4:]).tolist() == want


def test_components_of_a_chain_a_star_and_rings(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)] + [(5, 5)]
    ids = list(range(3000))
    rng.shuffle(ids)
    mixed = [(ids[a], ids[b]) for a, b in edges]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(mixed, "a long, b long")).collect()}
    assert got == brute.groups({x for e in mixed if e[0] != e[1] for x in e}, mixed)


def test_the_query_s_settings_compact_runs(spark, sf_dir, monkeypatch):
    """With its own batches and fanout a run of the second level is made, and the next batch meets it."""
    from tidemark.llm import queries

    levels = []
    whole = FingerprintLog.add

    def watched(self, batch):
        levels.append(sorted(x for x, _ in self.runs))
        return whole(self, batch)

    monkeypatch.setattr(FingerprintLog, "add", watched)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op1_substring_dedup(spark, sf_dir).collect()}
    assert got == brute.substring_dedup(docs, 50) and levels == [[], [0], [1]]
