"""The registered queries of this subpackage, each over its whole table, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import contamination
from .exact_dedup import exact_dedup
from .html_text import html_text
from .jaccard import jaccard_join
from .line_dedup import line_dedup
from .lm import lm_scores
from .mixing import mix_sources
from .pii import personal_data
from .quality import THRESHOLD, held_out, quality_scores
from .token_counts import VOCABULARY, edited_counts, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = quality_scores(docs, table(spark, sf_dir, "labels"))
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "secrets", "n_spans")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts of every text, and after three edits: in its middle, at its start and at its end."""
    n = F.length(F.coalesce("text", F.lit("")))
    at = [((n / 2).cast("int"), 5, " edited"), (F.lit(0), 1, ""), (n, 0, " appended words")]
    edits = F.array(*[F.struct(a.alias("at"), F.lit(r).alias("removed"), F.lit(i).alias("inserted")) for a, r, i in at])
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    counted = edited_counts(token_counts(docs, vocabulary), vocabulary)
    return counted.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_pieces", "n_encoded")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_extraction, op2_ngram_jaccard_join, op3_source_mixing, op4_quality_classifier, op5_line_dedup, op6_personal_data, op7_lm_scoring, op8_token_counts, op9_decontamination, op10_exact_dedup)
}

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
        sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
            ELSE list_transform(range(1, len(t) - 2), lambda i: array_to_string(list_slice(t, i, i + 3), ' ')) END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT a AS doc_id, b AS reach FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(reach) FROM r WHERE r.doc_id = w.doc_id), doc_id)) AS component_id
        FROM w LEFT JOIN n USING (doc_id)
    """,
    "op3_source_mixing": r"""
        WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        sums AS (SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source),
        weighed AS (SELECT source, s, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sums),
        filled AS (SELECT *, sum(s) OVER () - coalesce(sum(3 * s) OVER before, 0) AS left_s, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS left_w
            FROM weighed WINDOW before AS (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        level AS (SELECT min(CASE WHEN 3 * s * left_w > left_s * w THEN 3 * s / w END) AS r,
            arg_min(left_s, 3 * s / w) FILTER (3 * s * left_w > left_s * w) AS ls, arg_min(left_w, 3 * s / w) FILTER (3 * s * left_w > left_s * w) AS lw FROM filled),
        goals AS (SELECT source, s, CASE WHEN r IS NOT NULL AND 3 * s / w >= r THEN (ls * w)::DOUBLE / lw::DOUBLE ELSE (3 * s)::DOUBLE END AS target FROM filled, level),
        turned AS (SELECT doc_id, size, s, target, floor(target)::BIGINT AS quota,
            sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
            FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size::BIGINT AS size, s AS source_size, target,
            (CASE WHEN s = 0 THEN 0 ELSE size * (quota // s) + greatest(0, least(size, quota % s - upto + size)) END)::BIGINT AS taken FROM turned
    """,
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
        o AS (SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(points) OVER w AS most, count(*) OVER (PARTITION BY body) AS group_size
            FROM n WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND points = most AS kept, sha256(body) AS text_sha256 FROM o
    """,
}
