"""What a stored page gives to a document: one column expression over its row.

The expression is the caller's: a title, a cleaned column of the page table, or any
other. It stays inside the plan, so filters and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbundle.functions.names import html_title

# Fixed value: the error of a page that gives nothing.
NO_CONTENT = "no content found in the document"


def title_content() -> Column:
    """The page's title, the default content."""
    return html_title(F.col("html"))


def page_content(pages: DataFrame, content: Column | None = None) -> DataFrame:
    """Replace ``html`` by ``content``; where that is null, ``error`` tells so and the row stays."""
    value = title_content() if content is None else content
    kept = [c for c in pages.columns if c not in ("html", "content", "error")]
    return pages.select(*kept, value.alias("content")).withColumn(
        "error", F.when(F.col("content").isNull(), F.lit(NO_CONTENT))
    )
