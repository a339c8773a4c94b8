from pyspark.sql import functions as F

from corpusbundle.functions.names import (
    bundle_name,
    group_file_name,
    human_size,
    normalize_url_path,
    page_filename,
    page_filename_dashed,
    page_filename_error,
    sanitize_dashed,
    sanitize_name,
)
from corpusbundle.functions.text import file_section, non_blank, normalize_extract, page_section, strip
from corpusbundle.functions.urls import matched_path, resolve_override, url_allowed, url_host, url_path


def values(spark, inputs, build, kind="string"):
    rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, v {kind}")
    return [r.out for r in rows.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def texts(*items):
    return F.array(*map(F.lit, items)).cast("array<string>")


def test_sanitize_name(spark):
    inputs = ["Q3: sales (draft)", "a\\b/c", "v1.2.3-rc", "_x_", "  ", "", "§±~", "keep-dash_and_9"]
    expected = ["Q3_sales_draft", "a_b_c", "v1_2_3-rc", "x", "untitled", "untitled", "untitled", "keep-dash_and_9"]
    assert values(spark, inputs, sanitize_name) == expected
    assert values(spark, ["--a b--", "", "é"], sanitize_dashed) == ["a-b", "", ""]
    assert values(spark, ["/docs/a_b/", "/", "//x--y//"], normalize_url_path) == ["docs-a-b", "", "x-y"]


def test_page_filename(spark):
    cases = [
        ("<head><title>Annual report, 2023</title>", "https://acme.test/r", "Annual_report_2023.bundle.md", None),
        ("plain words", "https://acme.test/docs/faq?x=1", "acme_test_docs_faq.bundle.md", None),
        ("<title>\n Two\tparts </title>", "https://acme.test", "Two_parts.bundle.md", None),
        ("<title></title>", "https://acme.test#top", "acme_test.bundle.md", None),
        ("<title> 　</title>", "https://acme.test/", "acme_test.bundle.md", None),
        ("words", "just/a/path", None, "invalid URL: missing host"),
        ("words", "https://", None, "invalid URL: missing host"),
        ("words", "http://h/%zz", None, "invalid URL"),
        ("</title><title>x", "https://acme.test/a/", "acme_test_a.bundle.md", None),
        ("<TITLE>x</TITLE>", "http://h:80/a", "h_80_a.bundle.md", None),
    ]
    rows = spark.createDataFrame(
        [(i, c, u) for i, (c, u, _, _) in enumerate(cases)], "i int, html string, url string"
    )
    html, url = F.col("html"), F.col("url")
    found = rows.select("i", page_filename(html, url), page_filename_error(html, url)).orderBy("i")
    assert [tuple(r)[1:] for r in found.collect()] == [(n, e) for _, _, n, e in cases]
    dashed = rows.select("i", page_filename_dashed(html, url)).orderBy("i").limit(4).collect()
    assert [r[1] for r in dashed] == ["Annual-report-2023.md", "https-acme-test-docs-faq-x-1.md", "Two-parts.md", ".md"]


def test_group_and_bundle_names(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-05 06:07:08' AS t").select(
        bundle_name(F.lit("proj"), F.col("t")),
        group_file_name(F.lit(""), F.lit("/")),
        group_file_name(F.lit("site"), F.lit("/a/b")),
    ).first()
    assert tuple(row) == ("proj-20240305-060708.bundle.md", "doc-index.md", "site-a-b.md")


def test_human_size(spark):
    sizes = [0, 1023, 1024, 1280, 1048575, 1 << 30, 1 << 40, 5 << 60, 1075, 1331]
    expected = [
        "0 B", "1023 B", "1.0 KB", "1.2 KB", "1024.0 KB", "1.0 GB", "1.0 TB", "5.0 EB", "1.0 KB", "1.3 KB"
    ]
    assert values(spark, sizes, human_size, "bigint") == expected


def test_url_parts(spark):
    cases = {
        "https://acme.test/news/2024": ("acme.test", "/news/2024"),
        "http://u:p@h.com:80/a%20b?x#y": ("h.com:80", "/a b"),
        "http://h.com": ("h.com", ""),
        "http://h.com?q=/a": ("h.com", ""),
        "http://h.com#/f": ("h.com", ""),
        "http://h/a+b%2Bc": ("h", "/a+b+c"),
        "http://[::1]:80/x": ("[::1]:80", "/x"),
        "http://H.com//x": ("H.com", "//x"),
        "/rel/path": ("", "/rel/path"),
        "mailto:x@y": ("", ""),
        "http://h/%zz": (None, None),
        "http://h h/": (None, None),
        "http://h:port/": (None, None),
        "1a:b": (None, None),
        "http://h/a\tb": (None, None),
        "http://h/" + "é%20" * 3000: ("h", "/" + "é " * 3000),
    }
    urls = list(cases)
    assert values(spark, urls, url_host) == [cases[u][0] for u in urls]
    assert values(spark, urls, url_path) == [cases[u][1] for u in urls]


def test_url_allowed(spark):
    urls = {
        "https://shop.test/lamps/9": True,
        "https://shop.test/lampshades": True,
        "https://shop.test/chairs": True,
        "https://shop.test/lamps-old/1": False,
        "https://shop.test/chairs/used": False,
        "https://shop.test/": False,
        "https://www.shop.test/lamps/9": False,
        "https://shop.test:8443/lamps": False,
        "https://shop.test/%zz": False,
    }
    base = F.lit("https://shop.test")
    kept, dropped = texts("/lamps", "/chairs"), texts("/lamps-old", "/chairs/used")
    allowed = lambda c: url_allowed(c, base, kept, dropped)
    assert values(spark, list(urls), allowed) == list(urls.values())
    none = F.lit(None).cast("array<string>")
    assert values(spark, list(urls), lambda c: url_allowed(c, base, none, none)) == [False] * len(urls)
    assert values(spark, ["https://shop.test/lamps"], lambda c: url_allowed(c, base, texts("/"), none)) == [True]


def test_resolve_override(spark):
    kind = "array<struct<path:string,css_locator:string,exclude_selectors:array<string>>>"
    overrides = F.array(
        F.struct(F.lit("/wiki"), F.lit("#text"), texts(".toc", "nav")),
        F.struct(F.lit("/keep"), F.lit(""), texts(".x")),
        F.struct(F.lit("/bare"), F.lit("b"), texts()),
        F.struct(F.lit("/wiki/long"), F.lit("late"), texts(".late")),
    ).cast(kind)
    rules = lambda c: F.struct(*resolve_override(url_path(c), F.lit("div"), texts(".promo"), overrides))
    expected = {
        "about": ("div", [".promo"]),
        "wiki": ("#text", [".toc", "nav"]),
        "wiki/long/1": ("#text", [".toc", "nav"]),
        "wikis": ("#text", [".toc", "nav"]),
        "keep/1": ("div", [".x"]),
        "bare": ("b", []),
        "%zz": ("div", [".promo"]),
    }
    found = values(spark, [f"https://shop.test/{u}" for u in expected], rules)
    assert [tuple(r) for r in found] == list(expected.values())
    none = F.lit(None).cast(kind)
    bare = lambda c: F.struct(*resolve_override(url_path(c), F.lit("m"), texts(".a"), none))
    assert tuple(values(spark, ["http://h/x"], bare)[0]) == ("m", [".a"])


def test_matched_path(spark):
    paths = ["/blog/a", "/blogging", "/x", ""]
    first = lambda c: matched_path(c, texts("/blog", "/blogging", "/x/y"))
    assert values(spark, paths, first) == ["/blog", "/blog", None, None]
    any_path = lambda strict: lambda c: matched_path(c, texts(""), strict=strict)
    assert values(spark, paths, any_path(False)) == [""] * 4
    assert values(spark, paths, any_path(True)) == [None] * 4
    below = lambda c: matched_path(c, texts("/a"), F.lit("/docs"))
    assert values(spark, ["/docs/a/1", "/a/1", "/docs/b"], below) == ["/a", None, None]


def test_text_functions(spark):
    assert values(spark, ["  a b \n"], strip) == ["a b"]
    assert values(spark, ["", " \t\n　", "x"], non_blank) == [False, False, True]
    messy = " \r\n a \r  b\t\r\n\r\n c\n\n "
    assert values(spark, [messy], normalize_extract) == ["a\nb\n\nc"]
    section = lambda c: file_section(c, F.lit(" (n)"), F.lit("go"), F.lit("x"))
    assert values(spark, ["a/b.go"], section) == ["# File: a/b.go (n)\n\n```go\nx```\n\n"]
    assert values(spark, ["u"], lambda c: page_section(c, F.lit("t"))) == ["## u\n\nt\n\n"]
