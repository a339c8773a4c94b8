import random

from pyspark.sql import functions as F

from corpusbundle.functions.globs import (
    ext_in,
    file_ext,
    glob_match,
    in_hidden_dir,
    is_generated,
    is_ignored,
    is_text_ext,
    tree_key,
)


def outcomes(spark, paths, build):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string")
    found = rows.select("i", build(F.col("path")).alias("v")).orderBy("i").collect()
    return [r.v for r in found]


def test_glob_cases(spark):
    cases = [
        ("target/**", "target", False),
        ("target/**", "target/debug/app", True),
        ("target/**", "ws/target/app", False),
        ("**", "any/thing", True),
        ("**/cache/**", "webcache/x", True),
        ("[", "[", False),
        ("a[]b", "a[]b", False),
        ("", "", False),
        ("a?c", "abc", True),
        ("a?c", "a/c", False),
        ("a\\*c", "a*c", True),
        ("a\\*c", "abc", False),
        ("[^a-c]x", "dx", True),
        ("[^a-c]x", "bx", False),
        ("[z-a]x", "zx", False),
        ("x.rs", "xArs", False),
        ("x$", "x$", True),
        ("*.rs", "main.rs\n", False),
    ]
    paths = [path for _, path, _ in cases]
    each = lambda c: F.array(*(glob_match(c, p) for p, _, _ in cases))
    found = outcomes(spark, paths, each)
    assert [(p, q, row[i]) for i, (row, (p, q, _)) in enumerate(zip(found, cases))] == cases


def test_generated_cases(spark):
    """Only the last segment counts unless a double star says otherwise."""
    patterns = ["*.pb.cc", "**/stub[0-9]*.py", "parser_?.c"]
    found = {
        "api.pb.cc": True, "x/y/api.pb.cc": True, "lib/stub7a.py": True, "parser_1.c": True, "c/parser_z.c": True,
        "api.cc": False, "lib/stub.py": False, "parser_10.c": False, "parser_1.c/readme": False,
    }
    assert outcomes(spark, list(found), lambda c: is_generated(c, patterns)) == list(found.values())
    assert outcomes(spark, ["lib/b.c"], lambda c: is_generated(c, ["lib/*.c"])) == [False]
    assert outcomes(spark, ["b.c"], lambda c: is_generated(c, [""])) == [False]


def test_ignored_cases(spark):
    """Without a double star a pattern matches the path or its leading segments."""
    plain = outcomes(spark, ["out/a/b.txt", "x/out/b.txt"], lambda c: is_ignored(c, ["out"]))
    assert plain == [True, False]
    assert outcomes(spark, ["a/b"], lambda c: is_ignored(c, ["*"])) == [True]
    assert outcomes(spark, ["a/b"], lambda c: is_ignored(c, [])) == [False]


def filled(rng, pattern):
    """A path made from the pattern, so that it matches."""
    some = lambda low: "".join(rng.choice("ab") for _ in range(rng.randint(low, 3)))
    runs = ["", "a/", "b/ba/", "ab", "a/b"]
    out = ""
    for part in pattern.replace("**/", "\0").replace("**", "\0"):
        out += {"\0": rng.choice(runs), "*": some(0), "?": some(1)[:1]}.get(part, part)
    return out


def test_paths_made_from_a_pattern_match_it(spark):
    rng = random.Random(7)
    segments = ["a", "b", "*", "?", "a*", "*b", "a?b", "ab"]
    patterns = ["/".join(rng.choice(segments) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    patterns += [f"**/{p}" for p in patterns[:10]] + [f"{p}/**" for p in patterns[10:20]]
    patterns += [f"a/**/{p}" for p in patterns[20:30]]
    paths = [filled(rng, p) for p in patterns for _ in range(4)]
    found = outcomes(spark, paths, lambda c: F.array(*(glob_match(c, p) for p in patterns)))
    assert all(row[i // 4] for i, row in enumerate(found))


def test_broken_paths_do_not_match(spark):
    """A letter that no literal has, a segment too many or one too few."""
    patterns = ["a/b", "a*/b", "?/ab/*", "ab/a?b/b*"]
    paths = [c for p in patterns for q in [filled(random.Random(3), p)] for c in (f"{q}/a", f"z/{q}", "z" + q[1:] + "/z")]
    found = outcomes(spark, paths, lambda c: F.array(*(glob_match(c, p) for p in patterns)))
    assert not any(row[i // 3] for i, row in enumerate(found))


def test_extensions(spark):
    paths = ["a.go", "x/.bashrc", "noext", "a.tar.gz", "d.x/file", "end.", "A.GO"]
    assert outcomes(spark, paths, file_ext) == ["go", "bashrc", "", "gz", "", "", "GO"]
    wanted = ["go", "go", "bashrc", " md"]
    assert outcomes(spark, paths, lambda c: ext_in(c, wanted)) == [True, True] + [False] * 5
    assert outcomes(spark, ["end.", "noext"], lambda c: ext_in(c, [""])) == [True, False]
    assert outcomes(spark, ["swift", "exe", ""], is_text_ext) == [True, False, False]


def test_hidden_directories(spark):
    paths = [".git/x", "a/.b/c", ".env.md", "a/.env", "a.b/c"]
    assert outcomes(spark, paths, in_hidden_dir) == [True, True, False, False, False]


def test_tree_key_orders_by_segments(spark):
    paths = ["a/x.go", "a-b.go", "a/b/c", "a.go", "a/b-c", "é/x", "b"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    by_key = [r.path for r in rows.orderBy(tree_key(F.col("path"))).collect()]
    by_list = [r.path for r in rows.orderBy(F.split("path", "/")).collect()]
    assert by_key == by_list
    assert by_key.index("a/x.go") < by_key.index("a-b.go")
