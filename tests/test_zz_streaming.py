import os

from corpusbundle.operators.dedupe import keep_last
from corpusbundle.operators.durable import durable_table, release, shared_dir
from corpusbundle.sources.sites import sites_table
from corpusbundle.streaming.pages import write_converted


def test_pages_arriving_in_two_batches(spark, tmp_path):
    schema = "page_id long, url string, html string"
    site = {"base_url": "https://a.org", "css_locator": "i", "exclude_selectors": [], "allowed_paths": ["/x"]}
    sites = sites_table(spark, [site])
    arriving, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [(1, "https://a.org/x", "<title>old</title>"), (2, "https://a.org/no", "<title>no</title>")],
        [(3, "https://a.org/x", "<title>new</title>"), (4, "https://a.org/x2", None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(arriving)
        pages = spark.readStream.schema(schema).parquet(arriving)
        write_converted(pages, sites, out, str(tmp_path / "cp"), available_now=True).awaitTermination(120)
    found = spark.read.parquet(out)
    assert {(r.page_id, r.content) for r in found.collect()} == {(1, "old"), (3, "new"), (4, None)}
    latest = keep_last(found.drop("site"), ["url"], ["page_id"]).filter("error IS NULL")
    assert [(r.url, r.content, r.base_url) for r in latest.collect()] == [("https://a.org/x", "new", "https://a.org")]


def test_tables_can_be_released(spark):
    kept = durable_table(spark.range(3))
    folder = shared_dir(spark).removeprefix("file:") + "/tables"
    assert kept.count() == 3 and os.listdir(folder)
    release(spark)
    assert not os.path.exists(folder)
