"""The pipeline against its plain version; its last two stages draw at random, so their results are held to their rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.llm import brute


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, sf_dir).persist()
        assert docs.columns == before.columns
        kept[name] = (before, docs)
    rows = {name: ([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]) for name, (a, b) in kept.items()}

    before, after = rows["toxicity"]
    assert set(after) <= set(before) and len(after) >= 0.5 * len(before)

    before, after = rows["minhash_near_dedup"]
    found = brute.near_duplicates([(r[0], r[1]) for r in before], pipeline.PERCENT)
    assert sorted(after) == sorted(r for r in before if found[r[0]][1] == r[0])

    before, after = rows["substring_dedup"]
    cut = brute.substring_dedup([(r[0], r[1]) for r in before], 50)
    assert {r[0]: len(brute.words(r[1])) for r in after} == {i: n - gone for i, (n, gone, _) in cut.items()}
    assert all(r[4] == len(r[1]) for r in after)

    before, after = rows["mixing"]
    targets = brute.targets([(r[3], len(brute.words(r[1]))) for r in before])
    taken: dict = {}
    for r in after:
        taken[r[3]] = taken.get(r[3], 0) + len(brute.words(r[1]))
    longest = max(len(brute.words(r[1])) for r in before)
    assert all(abs(taken.get(s, 0) - t) <= longest for s, t in targets.items())

    packed = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in after}
    assert sum(r.piece == 0 for r in packed) == len(after)


def test_near_copies_at_a_similarity_of_080_go(spark, sf_dir):
    """Pairs that differ in one word: (S - 5) / (S + 5) of S shingles in common, 0.78 to 0.87."""
    import corpus_pipeline as pipeline

    docs = []
    for k, n in enumerate([*range(44, 76), 49, 49, 49]):
        words = [f"w{k}.{i}" for i in range(n)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[: n // 2], "other", *words[n // 2 + 1 :]]))]
    rows = [(i, text, "en", "web", len(text)) for i, text in docs]
    out = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf_dir)
    found = brute.near_duplicates(docs, 80)
    assert sorted(tuple(r) for r in out.collect()) == [r for r in rows if found[r[0]][1] == r[0]]
    assert found != brute.near_duplicates(docs, 85)


def test_stages_take_odd_rows(spark, sf_dir):
    """Nulls in every column, empty texts, repeated rows and ids, clashing further columns, and no rows at all."""
    import corpus_pipeline as pipeline

    text = " ".join(f"p{k}" for k in range(70))
    rest = " ".join(f"t{k}" for k in range(40))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, text, "en", "a", 300), (1, text, "en", "a", 300), (2, f"new start {text} {rest}", None, None, None), (3, None, "en", "a", 0), (4, "", "en", None, 0), (None, text, "en", "a", 5), (None, None, None, None, None), (6, "w", "en", "b", 1)]
    docs = spark.createDataFrame(rows, schema).withColumn("spans", F.lit("x")).withColumn("start", F.lit(1)).withColumn("size", F.lit(2)).withColumn("score", F.lit(3))
    stages = dict(pipeline.STAGES)

    def out(name):
        return sorted((tuple(r) for r in stages[name](spark, docs, sf_dir).collect()), key=str)

    assert out("toxicity") == sorted(rows, key=str)
    assert out("minhash_near_dedup") == sorted(rows, key=str)
    cut = out("substring_dedup")
    assert cut == sorted([*rows[:2], (2, f"new start {rest}", None, None, len(f"new start {rest}")), *rows[3:]], key=str)
    mixed = out("mixing")
    assert {r[0] for r in mixed} <= {1, 2, None, 6} and set(mixed) <= set(rows)
    packed = stages["packing"](spark, docs, sf_dir).collect()
    assert len(packed) == len(rows) and sum(r.length == 1 for r in packed) == 3
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
