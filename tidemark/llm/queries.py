"""The registered queries of this subpackage, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import split_join
from tidemark.llm.mixing import word_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substring_dedup import substring_dedup

    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.chat import canonical_turns, format_turns, masked_text, read_turns

    turns = canonical_turns(_table(spark, sf_dir, "conversations"))
    hard = "\\### Assistant: </turn> ok"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    out = format_turns(turns).withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', ''))
         + length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', '')) + 14 AS n FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op4_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.itq_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.minhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def without(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id is not among ``ids`` (a written table)."""
    return split_join(documents, ids, ["doc_id"], "left_anti")


def with_copies(documents: DataFrame, copies: DataFrame) -> DataFrame:
    """Documents with their number of copies (a written table: doc_key, size, copies); a null doc_id has a key too."""
    return documents.withColumn("doc_key", doc_key()).withColumn("size", word_count()).join(copies.hint("merge"), ["doc_key", "size"])


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))


def packed(documents: DataFrame) -> DataFrame:
    """The packing of op 7 with its digest of the ids; the tokenizer's files are looked up once, on the driver."""
    import public_tokenizers

    from tidemark.llm.packing import pack

    path = public_tokenizers.path
    out = pack(documents, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.urls import ALLOW, BLOCK, Rule, filter_urls

    rules = [Rule(BLOCK, "net", "/"), Rule(ALLOW, "example.net", "/en/"), Rule(BLOCK, "example.com", "/de/"), Rule(ALLOW, "org", "/fr/")]
    return filter_urls(_table(spark, sf_dir, "pages"), rules)


def op8_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.curve_search import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.html_text import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.alignment import align

    path = public_tokenizers.path
    return align(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.whitening import whitened

    return whitened(_table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _op10_sql() -> str:
    """Rules, links of the pages and reachability over them; the operator's own expressions in another dialect."""
    value = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def tag(name: str, key: str, word: str, wanted: str) -> str:
        """The wanted attribute's value in the first such tag whose key says the word."""
        said = rf"""\b{key}\s*=\s*["']?{word}\b"""
        pattern = rf"(?is)<{name}\b(?:[^>]*?{said}[^>]*?\b{wanted}{value}|[^>]*?\b{wanted}{value.replace("[^", "[^>")}[^>]*?{said})"
        return "replace(concat(" + ", ".join(f"regexp_extract(html, '{pattern.replace(chr(39), chr(39) * 2)}', {i})" for i in range(1, 7)) + "), '&amp;', '&')"

    def rule(host: str, path: str, of: str) -> str:
        rules = [("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block")]
        cases = (f"WHEN ({host} = '{h}' OR {host} LIKE '%.{h}') AND starts_with({path}, '{p}') THEN '{h + p if of == 'rule' else v}'" for h, p, v in rules)
        return f"CASE {' '.join(cases)} END"

    def host(url: str) -> str:
        return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def node(url: str) -> str:
        return f"CASE WHEN {host(url)} <> '' THEN {host(url)} || regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END"

    return f"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, {host('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, {node('url')} AS node FROM pages
), found AS (
  SELECT url, host, path, node, {tag('link', 'rel', 'canonical', 'href')} AS target FROM u WHERE html IS NOT NULL AND url IS NOT NULL
  UNION ALL SELECT url, host, path, node, regexp_extract({tag('meta', 'http-equiv', 'refresh', 'content')}, '(?is)url\\s*=\\s*[''"]?([^''"]+)', 1) FROM u WHERE html IS NOT NULL AND url IS NOT NULL
), named AS (
  SELECT node, trim(target) AS t, regexp_extract(url, '^(.*?://)', 1) || host AS site, regexp_replace(path, '[^/]*$', '') AS folder FROM found WHERE target <> ''
), whole AS (
  SELECT node AS a, CASE WHEN starts_with(t, '//') THEN 'http:' || t WHEN contains(t, '://') THEN t WHEN starts_with(t, '/') THEN site || t
    ELSE site || CASE WHEN folder = '' THEN '/' ELSE folder END || t END AS target FROM named
), ends AS (
  SELECT a, {node('target')} AS b FROM whole
), edges AS (
  SELECT a, b FROM ends WHERE a <> b UNION SELECT b, a FROM ends WHERE a <> b
), reach AS (
  SELECT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a
), judged AS (
  SELECT node, min({rule("regexp_extract(other, '(?s)^([^/?]*)', 1)", "regexp_extract(other, '(?s)^[^/?]*([^?]*)', 1)", 'verdict')}) AS shared FROM reach GROUP BY 1
)
SELECT page_id, host, path, {rule('host', 'path', 'rule')} AS rule, coalesce({rule('host', 'path', 'verdict')}, shared, 'allow') AS verdict
FROM u LEFT JOIN judged USING (node)
"""


OP10_SQL = _op10_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_mixing": op2_mixing,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_itq_near_dedup": op4_itq_near_dedup,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_curve_search": op8_curve_search,
        "op9_html_extraction": op9_html_extraction,
        "op10_url_filters": op10_url_filters,
        "op11_alignment": op11_alignment,
        "op12_whitening": op12_whitening,
        "op13_quality": op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": OP3_SQL, "op10_url_filters": OP10_SQL}
