"""Document blocks of HTML pages as typed elements."""

from __future__ import annotations

from pyspark.sql import DataFrame

BLOCK = "<(h1|h2|h3|p|li)(?:\\\\s[^>]*)?>([^<]*)"


def html_elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc_id, pos, tag, txt): the heading, paragraph and list item blocks of each page in order."""
    both = pages.selectExpr(f"{id_col} AS doc_id", f"regexp_extract_all({html_col}, '{BLOCK}', 1) AS a", f"regexp_extract_all({html_col}, '{BLOCK}', 2) AS b")
    return both.selectExpr("doc_id", "posexplode(arrays_zip(a, b)) AS (pos, z)").selectExpr("doc_id", "pos", "z.a AS tag", "trim(z.b) AS txt")


def typed(elements: DataFrame) -> DataFrame:
    """Adds type (heading, list_item or paragraph) and level (of a heading, else null)."""
    return elements.selectExpr(
        "doc_id", "pos", "CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'li' THEN 'list_item' ELSE 'paragraph' END AS type",
        "CASE WHEN tag LIKE 'h%' THEN CAST(substring(tag, 2, 1) AS INT) END AS level", "txt",
    )
