"""Search, replacement, redaction, sanitising and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import rules, sanitize
from quire.operators import search as S
from quire.plans.registry import query, table


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_EXAMPLE_ROWS = ", ".join(f"({-i}, {_quoted('example')}, {_quoted(t)})" for i, t in enumerate(S.EXAMPLES.values(), 1))
_WITH_EXAMPLES = f"(SELECT doc_id, lang, text FROM documents UNION ALL VALUES {_EXAMPLE_ROWS})"


def _with_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(-i, "example", t) for i, t in enumerate(S.EXAMPLES.values(), 1)]
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))


@query(
    " UNION ALL ".join(
        f"SELECT {_quoted(c)} AS category, lang, CAST(sum(len(regexp_extract_all(text, {_quoted(p)}))) AS BIGINT) AS n FROM {_WITH_EXAMPLES} d GROUP BY lang" for c, p in S.STANDARD.items()
    )
)
def redact_standard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the standard categories by language."""
    return S.counts(_with_examples(spark, sf_dir), S.STANDARD, ["lang"])


def _sql_redacted(text: str) -> str:
    for p in S.STANDARD.values():
        text = f"regexp_replace({text}, {_quoted(p)}, '█', 'g')"
    return text


@query(f"SELECT doc_id, {_sql_redacted('text')} AS redacted FROM {_WITH_EXAMPLES} d")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with all standard categories replaced."""
    return _with_examples(spark, sf_dir).select("doc_id", S.redact(F.col("text"), S.STANDARD.values()).alias("redacted"))


@query(
    " UNION ALL ".join(f"SELECT doc_id, {_quoted(c)} AS category, unnest(regexp_extract_all(text, {_quoted(S.STANDARD[c])})) AS match FROM {_WITH_EXAMPLES} d" for c in S.STANDARD)
)
def redaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match that redaction would take out."""
    return S.audit(_with_examples(spark, sf_dir), S.STANDARD, "doc_id")


@query(
    """WITH m AS (SELECT doc_id, unnest(range(1, len(h) + 1)) AS i, h, b FROM (SELECT doc_id, regexp_extract_all(text, '[Tt]he\\b') AS h, regexp_split_to_array(text, '[Tt]he\\b') AS b FROM documents) x),
    p AS (SELECT doc_id, CAST(i - 1 AS INT) AS n, h[i] AS match, CAST(sum(length(b[i]) + length(h[i])) OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS "end" FROM m)
    SELECT doc_id, n, CAST("end" - length(match) AS INT) AS start, "end", match FROM p"""
)
def search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of a pattern."""
    return S.matches(table(spark, sf_dir, "documents"), r"[Tt]he\b", "doc_id")


@query("SELECT conv_id, turn, regexp_replace(text, '([aeiou])r\\b', '\\1R', 'g') AS text FROM conversations WHERE turn < 2")
def replace_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern replaced on chosen pages."""
    return table(spark, sf_dir, "conversations").filter("turn < 2").select("conv_id", "turn", F.regexp_replace("text", S.java(r"([aeiou])r\b"), "$1R").alias("text"))


@query(sanitize.SQL)
def sanitize_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without scripts, active attributes and script links."""
    return sanitize.clean(sanitize.with_active(table(spark, sf_dir, "pages")), sanitize.ALL)


@query(sanitize.COUNTS_SQL)
def suspicious_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active content by kind before cleaning, and what remains after scripts alone are removed."""
    pages = sanitize.with_active(table(spark, sf_dir, "pages"))
    before = sanitize.suspicious(pages).withColumnRenamed("n", "n_before")
    after = sanitize.suspicious(sanitize.clean(pages, ("script",))).withColumnRenamed("n", "n_after")
    return before.join(after, "kind")


@query(rules.SQL)
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the strict profile."""
    return rules.validate(table(spark, sf_dir, "documents"), "strict")


@query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS n, string_agg(rule_no, ',' ORDER BY rule_no) AS rules FROM ({rules.SQL}) v GROUP BY doc_id")
def violations_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rules.validate(table(spark, sf_dir, "documents"), "strict")
    return v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("rule_no")), ",").alias("rules"))


@query(f"SELECT doc_id, {rules.FIXED_SQL} AS text FROM documents")
def apply_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts repaired so that the repairable rules hold."""
    return rules.conform(table(spark, sf_dir, "documents")).select("doc_id", "text")
