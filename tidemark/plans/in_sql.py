"""Registered queries written in SQL alone, with the engine's SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions import sql
from tidemark.plans import catalog as C
from tidemark.plans import inputs as I
from tidemark.plans.registry import query

SLOT, TRAINING = 100, 60


def _run(spark, text: str, **tables: DataFrame) -> DataFrame:
    """A query over DataFrames by name (in braces); the functions are registered in the caller's session."""
    sql.register(spark)
    return spark.sql(text, **tables)


@query(f"""WITH {I.TERMS}, tok AS (SELECT doc_id, unnest(words) AS term FROM termed), tfs AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY 1)
SELECT doc_id, term, tf, df, round((0.5 + 0.5 * tf / max(tf) OVER (PARTITION BY doc_id)) * ln((20000 // df)::DOUBLE), 6) AS weight, round(ln(20000::DOUBLE / df), 6) AS idf FROM tfs JOIN dfs USING (term)""")
def sql_tf_idf(spark, sf):
    return _run(
        spark,
        """WITH tok AS (SELECT doc_id, explode(words) AS term FROM (SELECT doc_id, words_of(text) AS words FROM {docs})), tfs AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY 1), mosts AS (SELECT *, max(tf) OVER (PARTITION BY doc_id) AS most FROM tfs)
SELECT doc_id, term, tf, df, round(tf_idf(tf, most, 20000, df), 6) AS weight, round(idf(20000, df), 6) AS idf FROM mosts JOIN dfs USING (term)""",
        docs=I.docs(spark, sf),
    )


@query(f"WITH {I.ROWS} SELECT term, term_hash, CAST(trunc(term_hash / 2.0) AS BIGINT) AS half FROM {C._SIGNED}")
def sql_hashes(spark, sf):
    return _run(spark, "SELECT term, string_hash(term) AS term_hash, half_toward_zero(string_hash(term)) AS half FROM (SELECT DISTINCT explode(terms) AS term FROM {items})", items=I.items(spark, sf))


@query(f"""WITH {I.ROWS}, x AS (SELECT doc_id, seq // {SLOT} AS slot, seq % {SLOT} < {TRAINING} AS training, label, term FROM tok),
c AS (SELECT slot, label, term, count(*) AS c FROM x WHERE training GROUP BY 1, 2, 3), l AS (SELECT slot, label, ln(sum(c) + 0.1) AS base FROM c GROUP BY 1, 2),
s AS (SELECT x.slot, x.doc_id, l.label, sum(ln(coalesce(c.c, 0) + 0.1) - base) AS score FROM x JOIN l ON l.slot = x.slot LEFT JOIN c ON c.slot = x.slot AND c.label = l.label AND c.term = x.term WHERE NOT training GROUP BY 1, 2, 3),
p AS (SELECT slot, doc_id, label AS prediction FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, label) = 1)
SELECT slot, doc_id, n.label, prediction FROM p JOIN numbered n USING (doc_id)""")
def sql_slot_predictions(spark, sf):
    """A model for each hundred items, trained on their first sixty, by a table function over partitions."""
    return _run(
        spark,
        f"""WITH asked AS (SELECT doc_id, label, terms, seq DIV {SLOT} AS slot, seq % {SLOT} < {TRAINING} AS training FROM {{items}})
SELECT slot, doc_id, p.label, prediction FROM slot_bayes(TABLE(SELECT doc_id, label, terms, slot, training FROM asked) PARTITION BY slot) p JOIN (SELECT doc_id, slot FROM asked) USING (doc_id)""",
        items=I.items(spark, sf),
    )
