from __future__ import annotations

import hashlib
import json
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tests.oracle import differences, tables
from tidemark.llm import chat, html_text, mixing, queries, tokens, toxicity, urls
from tidemark.llm.packing import Bins, cuts, pack
from tidemark.llm.tokens import Encoder

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def tokenizer():
    out = tokenizers.Tokenizer.from_file(FILES[0])
    out.encode_special_tokens = True
    return out


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    assert differences(queries.queries()[name](spark, sf_dir), tables(sf_dir), queries.oracle_sql()[name]) == ([], [])


# --- mixing -------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "Z"]), " ".join(["w"] * rng.choice([0, 1, 5, 40, 300]))) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_sources(df).collect()
    want = brute.targets([(s, len(brute.words(t))) for _, s, t in rows])
    source = {i: s for i, s, _ in rows}
    assert len(got) == len(rows)
    for s, target in want.items():
        own = [r for r in got if source[r.doc_id] == s]
        assert own[0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in own) - target) <= 300
        assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in own)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_the_last_open_document_is_a_small_one(spark):
    rng = random.Random(8)
    rows = [(i, "a" if i % 2 else "b", " ".join(["w"] * rng.choice([3, 3, 400, 3000]))) for i in range(1200)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    for s in "ab":
        own = [r for r in got if (r.doc_id % 2 == 1) == (s == "a")]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 400


def test_pivots_keep_expectations():
    ids, mass, share = list(range(50)), [float(1 + k % 9) for k in range(50)], [0.3] * 50
    runs = np.array([mixing.pivot([i + 1000 * r for i in ids], mass, share, 0, True) for r in range(600)])
    assert set(np.unique(runs)) == {0.0, 1.0}
    assert np.abs(runs.mean(axis=0) - 0.3).max() < 0.09
    assert np.abs(runs @ np.array(mass) - 0.3 * sum(mass)).max() <= 9


def test_mixing_edge_cases(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a", None), (1, "a", ""), (None, None, "x y"), (2, None, "x y")]
    got = mixing.mix_sources(spark.createDataFrame(rows, schema).withColumn("size", F.lit(9))).collect()
    assert sorted(r.size for r in got) == [0, 0, 2, 2] and all(r.taken <= 3 * r.size for r in got)
    nothing = mixing.mix_sources(spark.createDataFrame([(1, "a", " ")], schema)).first()
    assert (nothing.target, nothing.taken) == (0.0, 0)


# --- packing ------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab'sStTdmlrev1²é  \n\t.,!?-ß’日\x1c", max_size=40), min_size=1, max_size=5))
def test_ids_equal_the_tokenizers(texts):
    got = Encoder.of(*FILES).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 8))
def test_bins_never_overlap(lengths, most):
    bins, seen = Bins(64, most), {}
    for n in lengths:
        sequence, offset = bins.place(n)
        assert seen.get(sequence, 0) == offset
        seen[sequence] = offset + n
        assert seen[sequence] <= 64 and bins.count <= most


def test_cuts():
    assert cuts(5, 8) == [(0, 5)] and cuts(8, 8) == [(0, 8)]
    assert cuts(19, 8) == [(0, 3), (3, 8), (11, 8)] and cuts(16, 8) == [(0, 8), (8, 8)]


def test_pieces_that_share_a_hash_keep_their_ids(monkeypatch):
    """Were all pieces of one hash, each text would still get its own ids."""
    monkeypatch.setattr(tokens, "piece_hashes", lambda points, starts: np.diff(np.append(starts, len(points))).astype(np.uint64) % np.uint64(2))
    texts = ["one two three", "six ten", None, "", "a", "two one"]
    got = Encoder(*FILES).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [e.ids for e in tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_repeating_patterns_and_very_long_texts_keep_their_ids():
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    texts = [a, b, " ".join(f"word{k}" for k in range(300_000)), "é" * 100_000]
    got = Encoder(*FILES).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]


def test_bins_are_best_fits():
    """Against a plain list of open bins: the fullest that fits takes a piece, the fullest closes when all are open."""
    rng = random.Random(3)
    for most in (1, 3, 50):
        bins, opened, made = Bins(32, most), {}, 0
        for _ in range(400):
            n = rng.randint(1, 32)
            fits = [f for f in opened.values() if f >= n]
            sequence, offset = bins.place(n)
            if fits:
                assert opened[sequence] == min(fits) and offset == 32 - opened[sequence]
            else:
                assert (sequence, offset) == (made, 0)
                made += 1
                if len(opened) >= most and n < 32:
                    closed = min(opened.values())
                    gone = [s for s, f in opened.items() if f == closed and s not in {x for v in bins.free.values() for x in v}]
                    assert len(gone) == 1
                    del opened[gone[0]]
                opened[sequence] = 32
            opened[sequence] -= n
            if not opened[sequence]:
                del opened[sequence]
            assert len(opened) == bins.count


def test_packing_edge_cases(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), *FILES).count() == 0
    rows = [(1, "same text"), (1, "same text"), (None, "same text"), (2, None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("piece", F.lit("x")), *FILES).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"] and len({r.sequence_id for r in got}) == 1
    assert len({r.offset for r in got}) == 4 and sorted(r.length for r in got) == [1, 3, 3, 3]


def test_packing_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(spark.createDataFrame([(-1, None), (-2, ""), (None, "x")], "doc_id long, text string")).withColumn("length", F.lit(1))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pack(docs, *FILES, capacity=256).collect()
    whole, places = {}, {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.piece)):
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and r.start == len(whole.get(r.doc_id, []))
        whole.setdefault(r.doc_id, []).extend(ids.tolist())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    own = tokenizer()
    assert whole == {i: own.encode(t, add_special_tokens=False).ids + [0] for i, t in texts.items()}
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 256
    total = sum(r.length for r in rows)
    assert len(places) <= 1.05 * total / 256 + 4


# --- toxicity -----------------------------------------------------------------------------------


def labelled(n: int, seed: int):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(300)]
    texts, toxic = [], []
    for _ in range(n):
        w = rng.choices(vocabulary, k=rng.choice([20, 400]))
        bad = rng.random() < 0.2
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["Vileness!", "vilest", "vilely,", "rotten"])
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return pa.array(texts), np.array(toxic)


def test_model_generalises():
    model = toxicity.fit(*labelled(1500, 1))
    texts, toxic = labelled(500, 2)
    scores = model.scores(texts)
    assert ((scores >= 0.5) == toxic).mean() > 0.98
    empty, null, unseen, seen = model.scores(pa.array(["", None, "so vileish", "so vilest"]))
    assert empty == null < 0.5 < seen
    assert unseen > 1.5 * empty  # a form never seen shares a prefix


def test_pairs_are_learned():
    """Neither term says much alone; together they are toxic."""
    rng = random.Random(5)
    texts, toxic = [], []
    for _ in range(4000):
        a, b = rng.random() < 0.3, rng.random() < 0.3
        texts.append(" ".join(rng.choices("lorem ipsum dolor sit".split(), k=6) + ["insult"] * a + ["group"] * b))
        toxic.append(int(a and b))
    model = toxicity.fit(pa.array(texts), np.array(toxic), steps=600)
    alone, both = model.scores(pa.array(["lorem insult sit", "lorem group sit"])), model.scores(pa.array(["lorem insult group"]))
    assert alone.max() < 0.5 < both[0]
    assert np.abs(model.factors).max() > 0.1


def test_scores_are_sums_over_pairs():
    """Against w0 + sum of weights + sum over all pairs of distinct known terms of the products of their factors."""
    texts, toxic = labelled(300, 4)
    model = toxicity.fit(texts, toxic, steps=40)
    assert len(model.hashes) >= 3
    for text, score in zip(texts.slice(0, 60), model.scores(texts.slice(0, 60)), strict=True):
        found = sorted({int(h) for h in toxicity.terms(pa.array([text.as_py()]))[0]} & set(model.hashes.tolist()))
        at = [model.hashes.tolist().index(h) for h in found]
        margin = model.w0 + sum(model.weights[i] for i in at) + sum(float(model.factors[i] @ model.factors[j]) for k, i in enumerate(at) for j in at[k + 1 :])
        assert score == pytest.approx(1 / (1 + np.exp(-margin)))


def test_gradient_steps_lower_the_loss():
    texts, toxic = labelled(400, 6)

    def loss(model):
        p = np.clip(model.scores(texts), 1e-12, 1 - 1e-12)
        return -np.mean(np.where(toxic == 1, np.log(p), np.log(1 - p)))

    losses = [loss(toxicity.fit(texts, toxic, steps=n)) for n in (0, 5, 200)]
    assert losses[0] > losses[1] > losses[2]


def test_a_very_long_text_is_scored_whole():
    model = toxicity.fit(*labelled(1500, 1))
    clean = " ".join(f"word{k % 300}" for k in range(200_000))
    low, high = model.scores(pa.array([clean, clean + " vilest"]))
    assert low < 0.5 < high


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "x"), (2, None)], "doc_id long, text string").withColumn("score", F.lit("s"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxicity(docs, none).collect()] == [0, 0, 0, 0]
    odd = spark.createDataFrame([(1, None), (1, 1), (None, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, odd, keep=("text",)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


# --- chat formatting ----------------------------------------------------------------------------

HARD = ["\\### Assistant: </turn> ok", "", None, "a\n</turn>\n### user: b", "\\b\\l\\\\h:c", "日本 \U0001f600 text", ": x", "###"]


def test_template_reads_back(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "sys: tem", None, "a\\c<"]), rng.choice(HARD)) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(90, 0, "user", "tie"), (90, 0, "assistant", "tie"), (90, None, "user", "first"), (None, 1, "assistant", "z" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("at", F.lit(2))
    out = chat.format_turns(chat.canonical_turns(df)).select("conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    ties = spark.createDataFrame([(1, 0, "user", x) for x in ("#", "z", "<", "\\", "A", "[")], "conv_id long, turn long, role string, text string")
    tied = chat.format_turns(chat.canonical_turns(ties)).select(chat.read_turns(F.col("formatted")).alias("turns")).first().turns
    assert [t.text for t in tied] == sorted("#z<\\A[")
    want: dict = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    for r in out.collect():
        assert sorted((t.role, t.text) for t in r.turns) == sorted(want[r.conv_id])
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
        for s in r.loss_spans:
            assert "<" not in r.formatted[s.start - 1 : s.start - 1 + s.length]
    assert chat.format_turns(chat.canonical_turns(df.limit(0))).count() == 0


def test_layouts_are_told_by_their_fingerprints(spark):
    records = [
        {"prompt": "p", "response": "r", "more": 1},
        {"instruction": "i", "input": "x", "output": "o"},
        {"instruction": "i", "input": "", "output": "o"},
        {"messages": [{"role": "user", "content": "u"}, {"content": "c", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        {"question": "q", "answer": None},
        {"unknown": 1},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(98, None), (99, "{broken")]
    got: dict = {}
    for r in chat.json_turns(spark.createDataFrame(rows, "conv_id long, record string")).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {
        0: [("user", "p"), ("assistant", "r")],
        1: [("user", "i\n\nx"), ("assistant", "o")],
        2: [("user", "i"), ("assistant", "o")],
        3: [("user", "u"), ("assistant", "c")],
        4: [("user", "h"), ("assistant", "g")],
        5: [("user", "q"), ("assistant", "")],
    }
    table = spark.createDataFrame([(1, "i", "o", "extra")], "conv_id long, instruction string, output string, lang string")
    assert [(r.role, r.text) for r in chat.canonical_turns(table).orderBy("turn").collect()] == [("user", "i"), ("assistant", "o")]
    assert chat.layout_of(table.schema).fingerprint == hashlib.sha256(b"instruction\x1foutput").hexdigest()
    nested = spark.createDataFrame([(1, [("human", "h")])], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert [(r.role, r.text) for r in chat.canonical_turns(nested).collect()] == [("user", "h")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, y string"))


def test_chat_query_is_native(spark, sf_dir):
    plan = queries.queries()["op3_chat_formatting"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# --- urls ---------------------------------------------------------------------------------------

RULES = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "bad.com", "/"), urls.Rule("allow", "good.org", "/")]


def test_url_decisions_follow_aliases(spark):
    link = '<html><head><link href="{}" rel=canonical></head>'
    pages = [
        (1, "http://A.Example.NET/en/x?y#z", None),
        (2, "https://sub.x.net/", ""),
        (3, "https://x.net", "no path"),
        (4, None, None),
        (5, "nothing", ""),
        (6, "http://alias.one/a", link.format("http://bad.com/x&amp;y")),
        (7, "http://alias.two/a?q=1", "<meta content='0; URL=http://alias.one/a' http-equiv='Refresh'>"),
        (8, "http://alias.three/a", link.format("/b")),
        (9, "http://alias.three/b", link.format("//bad.com/")),
        (10, "http://alias.four/", link.format("http://bad.com/z")),
        (11, "http://bad.com/z", link.format("http://good.org/home")),
        (12, "http://plain.com/", link.format("")),
        (6, "http://alias.one/a", link.format("http://bad.com/x&amp;y")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit(0)).withColumn("node", F.lit(0))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, RULES).collect())
    assert got == [
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "sub.x.net", "/", "net/", "block"),
        (3, "x.net", "", None, "allow"),
        (4, "", "", None, "allow"),
        (5, "", "", None, "allow"),
        (6, "alias.one", "/a", None, "block"),
        (6, "alias.one", "/a", None, "block"),
        (7, "alias.two", "/a", None, "block"),
        (8, "alias.three", "/a", None, "block"),
        (9, "alias.three", "/b", None, "block"),
        (10, "alias.four", "/", None, "allow"),
        (11, "bad.com", "/z", "bad.com/", "block"),
        (12, "plain.com", "/", None, "allow"),
    ]
    shared = [(1, "http://s.org/view?id=1", link.format("http://bad.com/x")), (2, "http://s.org/view?id=2", ""), (3, "http://s.org/view?id=1#part", ""), (4, "http://t.org?q", link.format("http://bad.com?z")), (5, "http://t.org", "")]
    ids = {r.page_id: (r.path, r.verdict) for r in urls.filter_urls(spark.createDataFrame(shared, "page_id long, url string, html string"), RULES).collect()}
    assert ids == {1: ("/view", "block"), 2: ("/view", "allow"), 3: ("/view", "block"), 4: ("", "allow"), 5: ("", "allow")}
    long = [(1, "http://one.org/" + "a" * 100_000, link.format("http://bad.com/" + "b" * 100_000)), (2, "://?", ""), (3, "x://#://", "")]
    assert [r.verdict for r in urls.filter_urls(spark.createDataFrame(long, "page_id long, url string, html string"), RULES).orderBy("page_id").collect()] == ["block", "allow", "allow"]
    more = spark.createDataFrame([("http://plain.com/", "http://bad.com/q")], "url string, target string")
    assert {r.page_id: r.verdict for r in urls.filter_urls(df, RULES, more).collect()}[12] == "block"
    assert urls.filter_urls(df.limit(0), RULES).count() == 0


def test_url_sql_follows_links_too(spark, tmp_path):
    """The query and its SQL on pages with canonical and refresh links, of every form."""
    link = '<html><head><link href="{}" rel=canonical></head>'
    pages = [
        (1, "http://a.org/fr/x?y#z", link.format("http://b.info/x&amp;y?q")),
        (2, "https://b.info/x&y?q", "<LINK rel='canonical' href='//c.info'>"),
        (3, "https://c.info", "no link"),
        (4, None, link.format("http://a.net/")),
        (5, "nothing", link.format("http://a.net/")),
        (6, "http://alias.info/a/b", link.format("c?d=1")),
        (7, "http://alias.info/a/c?d=1", "<meta content='0; URL=http://x.NET/q' http-equiv='Refresh'>"),
        (8, "http://alias.info/e", "<link rel=other href=/f><link rel=canonical href=/g>"),
        (9, "http://alias.info/g#h", "<meta http-equiv=refresh content=\"5;url=/de/\">"),
        (10, "http://www.example.com/de/", link.format("")),
        (11, "http://www.example.com/en/", link.format("/de/")),
        (12, "http://d.info?x", link.format("y")),
        (13, "http://d.info/y", link.format("http://z.example.net/en/1")),
        (14, "http://e.info/", ""),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/p")
    pa.parquet.write_table(pa.concat_tables([pa.parquet.read_table(f) for f in sorted((tmp_path / "p").glob("*.parquet"))]), tmp_path / "pages.parquet")
    got = queries.op10_url_filters(spark, str(tmp_path))
    assert differences(got, tables(str(tmp_path)), queries.OP10_SQL) == ([], [])
    verdicts = {r.page_id: r.verdict for r in got.collect()}
    assert [verdicts[i] for i in (2, 3, 6, 7, 11, 12, 14)] == ["allow", "allow", "block", "block", "block", "allow", "allow"]


# --- html ---------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>no</p>";</script></head><body class="article-page">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>A very long menu entry, longer than many a paragraph of text would ever be</a></ul></nav>
<div class="cookie-notice">We use cookies to make this page better for you and for all of our partners, please accept them now.</div>
<main><h1>Title &amp; more</h1><p>First paragraph&nbsp;of   <b>text</b>, long enough to be the main content of this page, with some words more.
<p>Short.<p>Second <a href=x>linked</a> paragraph that goes on for a while so that the classifier believes it, &lt;really&gt;.
<div class="advert">Buy now! This advert is as long as any paragraph here, and has no link at all, but is no content.</div>
<form><p>Your mail address here, please, so that we can send you our newsletter every week.</p><button>Go</button></form>
<blockquote>A quoted line.</blockquote></main><section id="comments"><p>I read this and I think that it is a very good article, thank you so much for writing it.</p></section>
<aside>Related: many other things that could be read as well by those who like to read.</aside><footer>&copy; 2020</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE).split("\n") == [
        "Title & more",
        "First paragraph of text, long enough to be the main content of this page, with some words more.",
        "Short.",
        "Second linked paragraph that goes on for a while so that the classifier believes it, <really>.",
        "A quoted line.",
    ]


#: No element or name tells content from boilerplate here; text, links and neighbours must.
BARE = """<body><div><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></div><table><tr><td><a href=/long>{long}</a></td></tr><tr><td><a href=/4>Four</a></td></tr><tr><td>Mere words</td></tr>
<tr><td><a href=/5>Five</a></td></tr></table><div><p>{long} {long}</p><p>{long} {long}</p><div>As follows</div><p>{long} {long}</p><p>{long} {long}</p></div></body>"""


def test_edges_overturn_the_classifier():
    long = "This is a sentence that is long enough to be taken for the text of a page by what it says."
    page = html_text.Page(BARE.format(long=long))
    odds = page.features() @ html_text.START
    alone = [t for t, o in zip(page.texts, odds, strict=True) if o > 0]
    assert "As follows" not in alone
    assert page.text(html_text.START).split("\n") == [f"{long} {long}"] * 2 + ["As follows"] + [f"{long} {long}"] * 2


def test_pages_have_a_least_cut():
    """The labelling of each page costs as much as the best of all labellings."""
    rng = random.Random(11)
    names = ["p", "div", "li", "h2", "nav", "article", "aside", "section class=comments", "div class=promo", "td"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 11)):
            name = rng.choice(names)
            text = "word " * rng.choice([1, 3, 10, 40])
            parts.append(f"<{name}>{text if rng.random() < 0.7 else f'<a href=x>{text}</a>'}" + (f"</{name.split()[0]}>" if rng.random() < 0.6 else ""))
        page = html_text.Page("".join(parts))
        odds, edges = np.clip(page.features() @ html_text.START, -6, 6).tolist(), page.edges()
        content = html_text.minimum_cut(odds, edges)
        assert brute.cut_cost(odds, edges, content) == pytest.approx(brute.least_cut(odds, edges))
        assert page.text(html_text.START) == "\n".join(t for t, c in zip(page.texts, content, strict=True) if c)


def test_minimum_cut_is_minimal():
    """Against all labellings of small graphs."""
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(1, 9)
        terminal = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(rng.randint(0, 14))]
        assert brute.cut_cost(terminal, edges, html_text.minimum_cut(terminal, edges)) == pytest.approx(brute.least_cut(terminal, edges))


def test_long_pages_take_little_time():
    page = "<body>" + "".join(f"<div><a href=/{k}>Entry</a></div><p>{'Some text of a page, and more of it. ' * 5}Number {k}." for k in range(4000))
    start = time.perf_counter()
    text = html_text.main_text(page)
    assert time.perf_counter() - start < 5 and text.count("Number") == 4000 and "Entry" not in text


def test_weights_are_fitted():
    pages = [html_text.Page(PAGE)] * 3 + [html_text.Page(BARE)]
    labels = [p.labels() for p in pages]
    assert set(labels[0]) == {0, 1} and set(labels[3]) == {-1}
    x, y = np.concatenate([p.features() for p in pages]), np.concatenate(labels)
    fitted = html_text.fit(x, y)
    known = y >= 0
    assert ((x @ fitted > 0) == y)[known].mean() >= ((x @ html_text.START > 0) == y)[known].mean()
    assert (html_text.fit(x, np.full(len(y), -1)) == html_text.START).all()


def test_extraction_equals_a_plain_one(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: brute.article_text(r.html) for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(pages).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/pdivabr=\"' &;!-\nx", max_size=80))
def test_any_page_can_be_read(page):
    html_text.main_text(page)


def test_html_edge_cases(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>" + "long text " * 50), (2, "v", "<article><p>cut <b")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(3))).collect()
    assert sorted((r.text[:9], r.n_chars) for r in got) == [("", 0), ("", 0), ("cut", 3), ("long text", 499)]
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert hashlib.sha256(html_text.main_text(PAGE).encode()).hexdigest() == hashlib.sha256(html_text.main_text(PAGE + "</html>").encode()).hexdigest()


def test_toxicity_fits_one_text_of_an_id_and_no_very_long_ones(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "materialize", lambda df, name: seen.append(df.count()) or df)
    docs = [(1, "some words")] * 50 + [(2, "other words")] * 3 + [(3, "x " * toxicity.TRAIN_CHARS), (4, None)]
    known = [(i, i % 2) for i in range(1, 5)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    taken = []
    monkeypatch.setattr(toxicity, "_fit", lambda batches: (taken.append(1) for _ in batches))
    monkeypatch.setattr(toxicity, "held_out", lambda c: F.lit(False))
    whole = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema, *a, **k: taken.append(sorted(r.doc_id for r in self.collect())) or whole(self.limit(0), f, schema))
    toxicity.train(rows, spark.createDataFrame(known, "doc_id long, toxic int"))
    assert taken[0] == [1, 2, 4]


def test_toxicity_gradient_by_finite_differences():
    """One step of the fit moves each parameter against the slope of its loss."""
    rng = np.random.default_rng(3)
    n, k = 40, 6
    owner = np.repeat(np.arange(n), 3)
    term = np.concatenate([rng.choice(k, 3, replace=False) for _ in range(n)])
    label = rng.integers(0, 2, n)
    model = toxicity.Model(-0.3, np.arange(k, dtype=np.uint64), rng.normal(size=k), rng.normal(size=(k, toxicity.FACTORS)) / 3)

    def log_loss():
        margin, _ = model.margin(term, owner, n)
        return np.mean(np.logaddexp(0, margin) - label * margin)

    margin, sums = model.margin(term, owner, n)
    error = (1 / (1 + np.exp(-margin)) - label) / n
    slope_w = np.bincount(term, error[owner], k)
    for i in range(k):
        for place, slope in ((model.weights, slope_w[i]), (model.factors[:, 0], np.bincount(term, error[owner] * (sums[owner, 0] - model.factors[term, 0]), k)[i])):
            before = place[i]
            place[i] = before + 1e-5
            high = log_loss()
            place[i] = before - 1e-5
            low = log_loss()
            place[i] = before
            assert (high - low) / 2e-5 == pytest.approx(slope, abs=1e-7)
