"""Rule-based validation: profiles of named predicates, and repairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A rule is violated where its condition (SQL that Spark and DuckDB read alike) holds."""

    number: str
    detail: str
    violated: str


RULES = (
    Rule("6.1.1", "text is empty", "length(text) = 0"),
    Rule("6.1.2", "stated length differs from the text's", "n_chars <> length(text)"),
    Rule("6.1.3", "text is longer than 20000 characters", "length(text) > 20000"),
    Rule("6.2.1", "language is not stated", "lang IS NULL OR lang = ''"),
    Rule("6.2.2", "source is not of the form src<number>", "NOT (source LIKE 'src%') OR source IS NULL"),
    Rule("6.3.1", "text does not end with a full stop", "substring(text, length(text), 1) <> '.'"),
    Rule("6.3.2", "text holds a separator bar", "text LIKE '% | %'"),
    Rule("6.4.1", "text holds a secret assignment", "text LIKE '%token = %'"),
    Rule("6.4.2", "text holds repeated exclamation marks", "text LIKE '%!!%'"),
)

#: A profile is a choice of rules; stricter ones include the laxer.
PROFILES: dict[str, tuple[str, ...]] = {
    "basic": ("6.1.1", "6.1.2", "6.2.1", "6.2.2"),
    "accessible": ("6.1.1", "6.1.2", "6.2.1", "6.2.2", "6.3.1"),
    "strict": tuple(r.number for r in RULES),
}


def register_profile(name: str, numbers: tuple[str, ...]) -> None:
    """Adds a profile."""
    PROFILES[name] = numbers


def validate(docs: DataFrame, profile: str) -> DataFrame:
    """(doc_id, rule_no, detail) for each violated rule of a profile; all rules in one pass."""
    chosen = [r for r in RULES if r.number in PROFILES[profile]]
    each = F.array_compact(F.array(*(F.when(F.expr(r.violated), F.struct(F.lit(r.number).alias("rule_no"), F.lit(r.detail).alias("detail"))) for r in chosen)))
    return docs.select("doc_id", F.inline(each))


def conform(docs: DataFrame) -> DataFrame:
    """Texts repaired: bars become spaces, runs of exclamation marks one, and a full stop ends the text."""
    text = F.regexp_replace(F.regexp_replace("text", r" \| ", " "), "!!+", "!")
    return docs.withColumn("text", F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit("."))))


SQL = " UNION ALL ".join(f"SELECT doc_id, '{r.number}' AS rule_no, '{r.detail.replace(chr(39), chr(39) * 2)}' AS detail FROM documents WHERE {r.violated}" for r in RULES)
_T = r"regexp_replace(regexp_replace(text, ' \| ', ' ', 'g'), '!!+', '!', 'g')"
FIXED_SQL = f"CASE WHEN {_T} LIKE '%.' THEN {_T} ELSE {_T} || '.' END"
