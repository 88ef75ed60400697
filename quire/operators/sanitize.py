"""Removal of active content from pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of active content: what is found, and what it is replaced by.
KINDS: dict[str, tuple[str, str]] = {
    "script": (r"(?is)<script(?:[\s/][^>]*)?>.*?</script(?:[\s/][^>]*)?>", ""),
    "handler": (r' on[a-z]+="[^"]*"', ""),
    "script_uri": (r'href="javascript:[^"]*"', 'href="#"'),
    "external_uri": (r'href="https?://[^"]*"', 'href="#"'),
    "form_submit": (r'<form[^>]*action="[^"]*"[^>]*>', "<form>"),
}
ALL = tuple(KINDS)

#: The tables hold scripts alone, so pages get one example of each other kind.
ACTIVE = '<a href="javascript:go()" onclick="go()">x</a><a href="http://a.example">y</a><form action="/send">'


def with_active(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.concat("html", F.lit(ACTIVE)).alias("html"))


def clean(pages: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Pages without the chosen kinds."""
    html = F.col("html")
    for k in kinds:
        pattern, new = KINDS[k]
        html = F.regexp_replace(html, pattern, new)
    return pages.select("page_id", html.alias("html"))


def suspicious(pages: DataFrame) -> DataFrame:
    """(kind, n) of what the pages hold."""
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_count("html", F.lit(p)).cast("bigint").alias("n")) for k, (p, _) in KINDS.items()))
    return pages.select(F.inline(each)).groupBy("kind").agg(F.sum("n").alias("n"))



def _sql(kinds: Sequence[str], html: str) -> str:
    for k in kinds:
        pattern, new = KINDS[k]
        html = f"regexp_replace({html}, '{pattern}', '{new}', 'g')"
    return html


_PAGES = f"(SELECT page_id, html || '{ACTIVE}' AS html FROM pages)"
SQL = f"SELECT page_id, {_sql(ALL, 'html')} AS html FROM {_PAGES} p"
COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{k}' AS kind, CAST(sum(len(regexp_extract_all(html, '{p}'))) AS BIGINT) AS n_before, CAST(sum(len(regexp_extract_all({_sql(('script',), 'html')}, '{p}'))) AS BIGINT) AS n_after FROM {_PAGES} p"
    for k, (p, _) in KINDS.items()
)
