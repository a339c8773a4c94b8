import os
import random

import pytest
from pyspark.sql import functions as F

from corpusbundle.plans.files import FilePolicy, bundle_table, bundle_tree, part_listing
from corpusbundle.plans.profile import generated_policy
from corpusbundle.plans.web import grouped_pages
from corpusbundle.sinks.text import (
    write_combined_pages,
    write_grouped_pages,
    write_ordered,
    write_profile,
    write_tree_bundle,
)
from corpusbundle.sources.trees import read_content, scan_binary_tree, scan_tree

FILES = {
    "b_main.rs": "fn main() {}\n",
    "a/lib.rs": "pub fn two() -> u8 {\n    2\n}\n",
    "a/z.txt": "no line end",
    "a/data.csv": "x,y\n1,2\n",
    "c/api.pb.rs": "// made by a tool\n",
    "notes.txt": "ünder\nway\n",
    ".cargo/keys.txt": "secret\n",
    "third/dep/src/x.rs": "mod x;\n",
}
POLICY = FilePolicy(["rs", "txt"], ["*.csv", "third/**"], ["*.pb.rs"])


def plant(root, files):
    for rel, content in files.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(root)


def section(path, content, note=""):
    return f"# File: {path}{note}\n\n```{path.rsplit('.', 1)[1]}\n{content}```\n\n"


EXPECTED = "".join(
    section(p, FILES[p], " (Code-generated, Read-only)" if ".pb." in p else "")
    for p in ("a/lib.rs", "a/z.txt", "b_main.rs", "c/api.pb.rs", "notes.txt")
)


def whole(bundle):
    """The document of a tree bundle, or of the parts of a table."""
    parts = getattr(bundle, "parts", bundle)
    place = lambda r: (r.part_no, getattr(r, "piece_no", 0))
    return "".join(r.text for r in sorted(parts.collect(), key=place))


def joined_files(path):
    names = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    return "".join(open(os.path.join(path, n), newline="").read() for n in names)


def test_bundle_of_a_tree(spark, tmp_path):
    root = plant(tmp_path / "proj", FILES)
    for part_bytes in (1, 10**9):
        assert whole(bundle_tree(spark, root, POLICY, part_bytes)) == EXPECTED
    write_tree_bundle(spark, root, str(tmp_path / "out"), POLICY, 40)
    assert joined_files(tmp_path / "out") == EXPECTED


def test_bundle_of_a_table_equals_the_tree(spark):
    table = spark.createDataFrame(list(FILES.items()), "rel_path string, content string")
    assert whole(bundle_table(table, POLICY, part_bytes=40)) == EXPECTED


ODD = {
    ".env.md": "a", "_under.md": "b", "_posts/p.md": "c", ".hid/x.md": "d", "a/x.go": "e", "a-b.go": "f",
    "no_newline.md": "g", "fence.md": "```\nx\n```\n", "deep/1/2/3/4/f.txt": "h", "bad.txt": b"\xff\xfe ok",
    "old-20240101-000000.bundle.md": "earlier bundle", "empty.md": "", "Makefile": "m",
}


def test_scan_keeps_dot_and_underscore_files(spark, tmp_path):
    root = plant(tmp_path / "t", ODD)
    found = {r.rel_path: r.size for r in scan_tree(spark, root).collect()}
    assert set(found) == set(ODD) - {".hid/x.md"}
    assert found["bad.txt"] == 5 and found["empty.md"] == 0
    assert {r.rel_path for r in scan_tree(spark, root, prune_hidden=False).collect()} == set(ODD)
    skipped = scan_tree(spark, root, skip_under=["deep/**", "*.md"]).collect()
    assert {r.rel_path for r in skipped} == set(found) - {"deep/1/2/3/4/f.txt"}


def test_hidden_root_and_missing_root(spark, tmp_path):
    root = plant(tmp_path / ".secret", {"a.md": "x"})
    assert scan_tree(spark, root).count() == 0
    assert scan_tree(spark, root, prune_hidden=False).count() == 1
    with pytest.raises(Exception):
        scan_tree(spark, str(tmp_path / "absent")).count()


def test_links_are_listed_but_not_followed(spark, tmp_path):
    root = plant(tmp_path / "t", {"d/a.md": "x"})
    os.symlink(tmp_path / "t" / "d", tmp_path / "t" / "loop")
    assert {r.rel_path for r in scan_tree(spark, root).collect()} == {"d/a.md", "loop"}


def test_unreadable_files_are_reported(spark, tmp_path):
    root = plant(tmp_path / "t", {"a.md": "x\n", "b.md": "y\n"})
    os.symlink(tmp_path / "nowhere", tmp_path / "t" / "c.md")
    listing = scan_tree(spark, root)
    read = {r.rel_path: (r.content, r.read_error) for r in read_content(listing, root).collect()}
    assert read["a.md"] == ("x\n", None) and read["c.md"][0] is None and "NotFound" in read["c.md"][1]
    bundle = bundle_tree(spark, root, FilePolicy())
    assert whole(bundle) == section("a.md", "x\n") + section("b.md", "y\n")
    errors = write_tree_bundle(spark, root, str(tmp_path / "out"), FilePolicy())
    for found in (bundle.errors, errors):
        assert [(r.rel_path, "NotFound" in r.read_error) for r in found.collect()] == [("c.md", True)]


@pytest.mark.parametrize("part_bytes", [1, 3, 7, 64])
def test_files_larger_than_a_part_are_read_in_chunks(spark, tmp_path, part_bytes):
    files = {"a.md": "é漢🙂\n" * 9, "b.md": "no end 🙂", "c.md": "", "d.md": b"\xe6\xbc ok \xff\n" * 5, "e.md": "\n\n"}
    root = plant(tmp_path / "t", files)
    text = lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else v
    expected = "".join(section(p, text(v)) for p, v in files.items())
    bundle = bundle_tree(spark, root, FilePolicy(), part_bytes)
    assert whole(bundle) == expected
    rows = bundle.parts.collect()
    assert sum(r.n_sections for r in rows) == len(files)
    if part_bytes < 64:
        assert max(len(r.text) for r in rows) < len(section("a.md", files["a.md"]))
    write_tree_bundle(spark, root, str(tmp_path / "out"), FilePolicy(), part_bytes)
    assert joined_files(tmp_path / "out") == expected


def test_tasks_of_a_tree_are_cut_by_bytes(spark, tmp_path):
    files = {f"s{i:03}.md": "x" for i in range(300)} | {f"t{i}.md": "y" * 4000 for i in range(8)}
    root = plant(tmp_path / "t", files)
    write_tree_bundle(spark, root, str(tmp_path / "out"), FilePolicy(), 4000)
    sizes = {r.n for r in part_listing(spark, root, FilePolicy(), 4000).groupBy(F.spark_partition_id()).agg(F.sum("size").alias("n")).collect()}
    assert max(sizes) <= 2 * 4000 + 1 and len(sizes) > 1
    assert joined_files(tmp_path / "out") == "".join(section(p, v) for p, v in sorted(files.items()))


def test_odd_tree_bundle(spark, tmp_path):
    root = plant(tmp_path / "t", ODD)
    order = [
        ".env.md", "_posts/p.md", "_under.md", "a/x.go", "a-b.go", "bad.txt", "deep/1/2/3/4/f.txt", "empty.md",
        "fence.md", "no_newline.md",
    ]
    order.sort(key=lambda p: p.split("/"))
    text = lambda p: ODD[p].decode("utf-8", "replace") if isinstance(ODD[p], bytes) else ODD[p]
    expected = "".join(section(p, text(p)) for p in order)
    assert whole(bundle_tree(spark, root, FilePolicy(["go", "md", "txt", "md"], skip_bundles=True), 30)) == expected


def test_binary_scan_reads_only_what_is_asked(spark, tmp_path):
    root = plant(tmp_path / "t", {"d/a.md": "é\n", "_b.md": "x"})
    plant(tmp_path / "t", {"d/bad.md": b"\xff ok"})
    for name in (root, f"file://{root}", f"{root}/"):
        found = scan_binary_tree(spark, name)
        rows = {(r.rel_path, r.size, r.content) for r in found.collect()}
        assert rows == {("d/a.md", 3, "é\n"), ("d/bad.md", 4, "\ufffd ok")}
    plan = found.select("rel_path", "size")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_ordered_text_is_byte_exact(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, f"s{i}" + "\n" * rng.randint(1, 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o int, t string").repartition(4)
    write_ordered(df, str(tmp_path / "one"), ["o"], "t", parts=5)
    assert joined_files(tmp_path / "one") == "".join(t for _, _, t in rows)
    write_ordered(df, str(tmp_path / "many"), ["o"], "t", by=["k"], parts=5)
    for key in "ab":
        assert joined_files(tmp_path / "many" / f"k={key}") == "".join(t for k, _, t in rows if k == key)


def converted(spark):
    rows = [("https://a.org", "a", ["/x", "/y"], u, c) for u, c in [
        ("https://a.org/x/2", "two"), ("https://a.org/x/1", "one"), ("https://a.org/y", "why")]]
    rows += [("https://b.org", "a", ["/x"], "https://b.org/x", "b"), ("https://b.org", "e", ["/"], "https://b.org/", " ")]
    df = spark.createDataFrame(rows, "b string, p string, allowed array<string>, url string, markdown string")
    site = F.struct(
        F.col("b").alias("base_url"), F.col("p").alias("file_name_prefix"), F.col("allowed").alias("allowed_paths")
    )
    path = F.regexp_replace("url", "https://[ab].org", "")
    return df.select("url", path.alias("url_path"), site.alias("site"), "markdown")


def test_page_sinks(spark, tmp_path):
    pages = converted(spark)
    write_combined_pages(pages, "markdown", str(tmp_path / "single"))
    assert joined_files(tmp_path / "single") == (
        "## https://a.org/x/1\n\none\n\n## https://a.org/x/2\n\ntwo\n\n## https://a.org/y\n\nwhy\n\n"
        "## https://b.org/\n\n \n\n## https://b.org/x\n\nb\n\n"
    )
    write_grouped_pages(grouped_pages(pages, "markdown"), str(tmp_path / "groups"))
    found = {joined_files(tmp_path / "groups" / d): d for d in os.listdir(tmp_path / "groups") if "=" in d}
    # Both sites have a group a-x.md; the blank group of b.org is left out.
    assert set(found) == {"one\n\ntwo\n\n", "why\n\n", "b\n\n"}
    assert found["why\n\n"] == "file_name=a-y.md" and found["b\n\n"].startswith("file_name=a-x-")


def test_generated_profile(spark, tmp_path):
    root = plant(tmp_path / "t", {**FILES, ".hidden/x.py": "p"})
    policy = generated_policy(scan_tree(spark, root, prune_hidden=False))
    write_profile(policy, str(tmp_path / "profile"))
    back = spark.read.json(str(tmp_path / "profile")).first()
    assert back.file_extensions == ["py", "rs", "txt"]
    assert back.ignore_paths == ["node_modules/**", "vendor/**", ".git/**"]
