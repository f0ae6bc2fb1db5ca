"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. One Arrow pass over the texts gives each document the size and a 128-bit digest
   of its set of 5-word shingles and its band keys (`superminhash.signatures`).
   Documents with equal sets are one class, named by its smallest doc_id.
2. Classes that share a band key are candidates. Each bucket is chained to its
   smallest member, and connected components over those chains make candidate
   groups: whoever shares a bucket is in one group, so no candidate pair is lost.
3. Groups are cut into blocks of `BLOCK` classes, ordered by set size. First every
   block meets its group's first block of each size class; then the blocks of
   classes that are still outside their group's largest component meet all
   blocks of comparable size. A meeting computes all intersections
   of the two blocks' full sets exactly and returns a spanning forest of the links it
   found, never the pairs. Pairs inside one component need no test; every other pair
   of a group is tested, so verification is complete without a cap.
4. Connected components over the links give the groups of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, materialize, small_batches, split_join
from tidemark.llm.superminhash import band_keys, signatures
from tidemark.llm.words import FIRST, SECOND, Words, chunks, mix, signed, windows

SHINGLE_WORDS = 5
#: 24 bands of 6 slots: a pair of similarity 0.85 shares no band with probability 1e-5; at 0.80 that takes 40 bands.
BANDS, ROWS = 24, 6
PERCENT = 85
BLOCK = 64
#: Set elements that one meeting holds as a dense matrix at once.
COLUMNS = 8192


def shingle_sets(column: pa.Array, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, their text's number), ascending by text, of a chunk of texts."""
    with np.errstate(over="ignore"):
        words = Words(column, lower=True)
        hashed = words.hashes()
        count = np.diff(words.at)
        starts, before = windows(words.at, size)
        short = np.flatnonzero((count > 0) & (count < size))
        owner = np.concatenate([np.repeat(np.arange(len(count)), np.diff(before)), short])
        shingles = np.concatenate([FIRST.runs(hashed, size)[starts], FIRST.spans(hashed, words.at[short], words.at[short + 1])])
        order = np.argsort(shingles)
        order = order[np.argsort(owner[order], kind="stable")]
        shingles, owner = shingles[order], owner[order]
        first = np.ones(len(shingles), bool)
        first[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
        return shingles[first], owner[first]


def _sketch(n_bands: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in chunks(batch.column(1)):
                ids, texts = batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start)
                n = stop - start
                elements, owner = shingle_sets(texts)
                at = np.searchsorted(owner, np.arange(n + 1))
                digests = []
                with np.errstate(over="ignore"):
                    for own in (FIRST, SECOND):
                        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements ^ own.salt[0]))])
                        digests.append(signed(sums[at[1:]] - sums[at[:-1]]))
                keys = band_keys(signatures(elements, owner, n, n_bands * ROWS), n_bands)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * n_bands + 1, n_bands, dtype=np.int32)), pa.array(signed(keys.ravel())))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), pa.array(digests[0]), pa.array(digests[1]), bands], ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return sketch


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in chunks(batch.column(1)):
            elements, owner = shingle_sets(batch.column(1).slice(start, stop - start))
            at = np.searchsorted(owner, np.arange(stop - start + 1)) * 8
            packed = pa.Array.from_buffers(pa.binary(), stop - start, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(elements)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), packed], ["doc_id", "elements"])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections of two lists of sets (sorted distinct uint64)."""
    owner = np.concatenate([np.full(len(s), i) for i, s in enumerate([*left, *right])])
    values, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    shared = np.flatnonzero(np.bincount(code, minlength=len(values)) > 1)
    rank = np.full(len(values), -1)
    rank[shared] = np.arange(len(shared))
    keep = rank[code] >= 0
    owner, code = owner[keep], rank[code][keep]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, len(shared), COLUMNS):
        a, b = np.searchsorted(code, [low, low + COLUMNS])
        table = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        table[owner[a:b], code[a:b] - low] = 1
        out += np.rint(table[: len(left)] @ table[len(left) :].T).astype(np.int64)
    return out


def forest(links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a bipartite link matrix, by union-find over the two id lists."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(links), strict=True):
        a, b = find(int(rows[i])), find(int(columns[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(rows[i]), int(columns[j])))
    return out


def _meet(percent: int):
    def meet(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        ids = table["doc_id"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["elements"].combine_chunks()]
        here = np.flatnonzero(side <= 1)
        there = np.flatnonzero(side >= 1)
        if not len(here) or not len(there):
            found = []
        else:
            size = np.array([len(s) for s in sets], np.int64)
            common = intersections([sets[i] for i in here], [sets[j] for j in there])
            whole = size[here][:, None] + size[there][None, :] - common
            links = (100 * common >= percent * whole) & (ids[here][:, None] != ids[there][None, :]) & (common > 0)
            found = forest(links, ids[here], ids[there])
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return meet


def _meetings(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links found when the blocks of each meeting are compared. members: meeting columns, side (0 left, 1 both, 2 right), doc_id."""
    rows = members.join(sets, "doc_id").select("grp", "p", "q", "side", "doc_id", "elements")
    return rows.groupBy("grp", "p", "q").applyInArrow(_meet(percent), "a long, b long")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Null and empty texts have no shingles and link with nothing. Rows that repeat a
    doc_id each come back; they share a component when their ids or sets are equal.
    A row whose id is null is its own component (component_id null, kept true).
    Other columns are not read, so their names can't clash.
    """
    spark = documents.sparkSession
    docs = small_batches(documents).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = materialize(docs.mapInArrow(_sketch(bands), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "minhash-sketch")
    digest = ["n_shingles", "s1", "s2"]
    filled = sketch.where("n_shingles > 0 and doc_id is not null")
    # One row per distinct set; equal sets have equal bands, so any member's will do.
    classes = materialize(filled.groupBy(*digest).agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands")), "minhash-classes")
    keys = classes.select("class_id", F.explode("bands").alias("key"))
    keys = materialize(keys, "minhash-keys")
    least = materialize(keys.groupBy("key").agg(F.min("class_id").alias("b"), F.max("class_id").alias("most")).where("b < most").select("key", "b"), "minhash-buckets")
    chains = split_join(keys, least, ["key"], "inner").where("class_id > b").select(F.col("class_id").alias("a"), "b").distinct()
    groups = connected_components(chains, "minhash-groups")
    sized = groups.join(classes.select(F.col("class_id").alias("node"), "n_shingles").groupBy("node").agg(F.max("n_shingles").alias("n")), "node")
    sized = materialize(sized.select(F.col("root").alias("grp"), F.col("node").alias("doc_id"), "n"), "minhash-grouped")
    sets = split_join(docs, sized.select("doc_id"), ["doc_id"], "left_semi")
    sets = materialize(sets.mapInArrow(_sets, "doc_id long, elements binary"), "minhash-sets")

    blocks = materialize(_blocks(sized, percent), "minhash-blocks")
    links = materialize(_meetings(_first_round(blocks), sets, percent), "minhash-links")
    again = _second_round(blocks, links, percent)
    if again is not None:
        links = links.unionByName(materialize(_meetings(again, sets, percent), "minhash-links"))
    roots = connected_components(links, "minhash-roots")
    names = materialize(classes.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select(*digest, F.coalesce("root", "class_id").alias("component_id")), "minhash-named")
    out = sketch.select("doc_id", *digest).join(names, digest, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def _blocks(sized: DataFrame, percent: int) -> DataFrame:
    """Members of each group in blocks of at most about BLOCK, of one size class.

    Sizes of linked sets differ by a factor of 100 / percent at most, so they are in the same or in adjacent classes.

    Group and size class are cut by a hash, not by a sort, so that a group of any
    size needs no single task; block numbers are dense enough for pairing.
    """
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.1 / percent))).cast("int")
    rows = sized.withColumn("level", level)
    count = materialize(rows.groupBy("grp", "level").agg(F.count("*").alias("members")), "minhash-levels")
    rows = rows.join(count, ["grp", "level"])
    cut = F.ceil(F.col("members") / BLOCK)
    return rows.select("grp", "level", "doc_id", "n", cut.cast("int").alias("cuts"), F.pmod(F.xxhash64("doc_id"), cut).cast("int").alias("block"))


def _numbered(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("at", F.col("level") * F.lit(1 << 32).cast("long") + F.col("block"))


def _first_round(blocks: DataFrame) -> DataFrame:
    """Every block meets itself, and block 0 of its own size class and of the next lower one."""
    rows = _numbered(blocks)
    hub = F.col("block") == 0
    # A block-0 row also goes to all other blocks of its level and of the levels above; those are listed once per level.
    levels = materialize(blocks.groupBy("grp", "level").agg(F.max("cuts").alias("others")), "minhash-hubs")
    own = rows.select("grp", F.col("at").alias("p"), F.col("at").alias("q"), F.lit(1).alias("side"), "doc_id")
    out = own
    for up in (0, 1):
        target = levels.select("grp", (F.col("level") - up).alias("level"), "others", F.col("level").alias("up_level"))
        first = 1 if up == 0 else 0
        to = rows.where(hub).join(target, ["grp", "level"]).where(F.col("others") > first)
        to = to.select("grp", F.col("at").alias("p"), F.explode(F.sequence(F.lit(first), F.col("others") - 1)).alias("block"), "up_level", "doc_id")
        left = to.select("grp", "p", (F.col("up_level") * F.lit(1 << 32).cast("long") + F.col("block")).alias("q"), F.lit(0).alias("side"), "doc_id")
        source = levels.select("grp", (F.col("level") + up).alias("level"), F.col("level").alias("hub_level"))
        right = rows.join(source, ["grp", "level"]).where(F.col("block") >= first)
        right = right.select("grp", (F.col("hub_level") * F.lit(1 << 32).cast("long")).alias("p"), F.col("at").alias("q"), F.lit(2).alias("side"), "doc_id")
        out = out.unionByName(left).unionByName(right)
    return out


def _second_round(blocks: DataFrame, links: DataFrame, percent: int) -> DataFrame | None:
    """Classes outside their group's largest component, in blocks of their own, meet all blocks of comparable size.

    Only groups with more than one block in reach need it: in the others every pair has met.
    """
    many = blocks.groupBy("grp").agg(F.max("cuts").alias("most")).where("most > 1").select("grp")
    rows = materialize(blocks.join(many, "grp", "left_semi"), "minhash-large")
    if not rows.limit(1).count():
        return None
    roots = connected_components(links, "minhash-part")
    named = rows.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    named = materialize(named, "minhash-parts")
    sizes = materialize(named.groupBy("grp", "root").agg(F.count("*").alias("size")), "minhash-part-sizes")
    largest = materialize(sizes.groupBy("grp").agg(F.max_by("root", F.struct("size", -F.col("root"))).alias("main")), "minhash-main")
    apart = named.join(largest, "grp").where("root <> main")
    apart = materialize(apart.select("grp", "level", "doc_id", "n"), "minhash-apart")
    if not apart.limit(1).count():
        return None
    left = _numbered(_blocks(apart, percent)).select("grp", "level", "at", "doc_id")
    left = materialize(left, "minhash-left")
    right = _numbered(rows).select("grp", "level", "at", "doc_id")
    left_blocks = materialize(left.groupBy("grp", "level", "at").agg(F.lit(1).alias("one")), "minhash-left-blocks").drop("one")
    right_blocks = materialize(right.groupBy("grp", "level", "at").agg(F.lit(1).alias("one")), "minhash-right-blocks").drop("one")
    near = F.explode(F.array(*[F.col("level") + i for i in range(-1, 2)]))
    other = left_blocks.select("grp", F.col("at").alias("p"), near.alias("level"))
    meets = materialize(other.join(right_blocks.withColumnRenamed("at", "q"), ["grp", "level"]).select("grp", "p", "q"), "minhash-meets")
    a = left.withColumnRenamed("at", "p").join(meets, ["grp", "p"]).select("grp", "p", "q", F.lit(0).alias("side"), "doc_id")
    b = right.withColumnRenamed("at", "q").join(meets, ["grp", "q"]).select("grp", "p", "q", F.lit(2).alias("side"), "doc_id")
    return a.unionByName(b)
