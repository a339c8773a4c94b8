"""Pages that keep arriving: the page plan of the batch, batch by batch.

Which site has a page is settled as in the batch plan, by look-ups of (host, path prefix) in
rules that are indexed once. No state is held between batches: a page has one winner among the
sites whatever arrived before. Bundles are made from the written table by the batch plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusbundle.operators.lookups import SiteIndex, allowed_urls, site_index
from corpusbundle.plans.web import converted_pages


def convert_batch(pages: DataFrame, index: SiteIndex, content: Column | None = None) -> DataFrame:
    """Pages (page_id, url, html) of one batch that a site allows, one row each, with their content.

    Keeps ``page_id`` so that ``keep_last`` can later settle repeated URLs.
    """
    allowed = allowed_urls(pages.select("url").distinct(), index)
    return converted_pages(pages.join(allowed, "url").join(index.sites, "site_no").drop("site_no"), content)


def write_converted(
    pages: DataFrame,
    sites: DataFrame,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    content: Column | None = None,
) -> StreamingQuery:
    """Write converted pages to a parquet table; failed pages keep their error value.

    Each batch has a folder of its own (the column ``batch``), which a batch that is run again
    after a failure writes anew, so no page is written twice. The rules are read when the
    stream starts.
    """
    index = site_index(sites)

    def write(batch: DataFrame, number: int) -> None:
        out = convert_batch(batch, index, content).withColumn("base_url", F.col("site.base_url"))
        out.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
