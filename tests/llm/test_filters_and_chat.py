"""URL reputation, decontamination and chat formatting."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpusbundle.llm.decontamination as decontamination
from corpusbundle.llm.chat import rotate_perspectives
from corpusbundle.llm.decontamination import contaminated, drop_contaminated
from corpusbundle.llm.queries import QUERIES, URL_RULES
from corpusbundle.llm.reputation import domain_of, judge_urls, reputations, suffix_of
from tests.llm.frames import ODD, documents, passage, words

SF = "/root/testdata/sf0.001"

# URLs.

URLS = {
    None: ("", "", None),
    "": ("", "", None),
    "no scheme/at/all": ("", "", None),
    "http://": ("", "", None),
    "https://Example.COM/en/1?x#y": ("example.com", "/en/1", "example.com/en/"),
    "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
    "https://a.www.example.com/en/2": ("a.www.example.com", "/en/2", "www.example.com/en/"),
    "https://notexample.com/en/2": ("notexample.com", "/en/2", "com/"),
    "http://x.net/es/1": ("x.net", "/es/1", "net/es/"),
    "http://x.net/esp": ("x.net", "/esp", None),
    "http://x.net/fr/": ("x.net", "/fr/", "net/fr/"),
    "http://x.com": ("x.com", "", None),
    "http://x.com?q=/": ("x.com", "", None),
    "http://x.com/a://b.net/es/": ("x.com", "/a://b.net/es/", "com/"),
    "ftp://ÄB.net:80/fr/#": ("Äb.net:80", "/fr/", None),
    "x\n://h.net/es/\nq": ("h.net", "/es/\nq", "net/es/"),
}


def test_hosts_paths_and_rules(spark):
    rows = [(k, u, "h", "v", "r") for k, u in enumerate(URLS)] + [(None, "http://x.com/", "h", "v", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, rule string")
    none = spark.createDataFrame([], "url string, good boolean")
    found = {r.page_id: r for r in judge_urls(pages, none, URL_RULES).collect()}
    assert len(found) == len(rows)
    verdicts = {h + p: v for v, h, p in URL_RULES}
    for k, (host, path, rule) in enumerate(URLS.values()):
        row = found[k]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        # Without outcomes the posterior is flat, and its lower bound is below one half.
        assert row.verdict == verdicts.get(rule, "block")


def test_reputations_shrink_towards_their_parents(spark):
    good = [("https://a.fine.org/x", True)] * 60 + [("https://b.fine.org/x", True)] * 40
    bad = [("https://spam.bad.net/x", False)] * 60 + [("https://more.bad.net/y", False)] * 3
    mixed = [("https://one.odd.net/x", k % 2 == 0) for k in range(40)]
    other = [(None, True), ("https://a.fine.org", None), ("nothing", False)]
    outcomes = spark.createDataFrame(good + bad + mixed + other, "url string, good boolean")
    mean = {(r.level, r.name): r.alpha / (r.alpha + r.beta) for r in reputations(outcomes).collect()}
    assert mean["all", ""] == pytest.approx(121 / 205)
    assert mean["host", "a.fine.org"] > mean["domain", "fine.org"] * 0.99 > mean["all", ""]
    assert mean["host", "spam.bad.net"] < mean["host", "more.bad.net"] < mean["suffix", "net"]
    assert 0.3 < mean["host", "one.odd.net"] < 0.7
    counts = {(r.level, r.name): (r.n, r.good) for r in reputations(outcomes).collect()}
    assert counts["suffix", "net"] == (103, 20) and counts["domain", "bad.net"] == (63, 0)

    pages = [(1, "https://a.fine.org/z"), (2, "https://new.fine.org"), (3, "https://spam.bad.net/"), (4, "https://c.bad.net/")]
    judged = judge_urls(spark.createDataFrame(pages, "page_id long, url string"), outcomes).collect()
    assert {r.page_id: r.verdict for r in judged} == {1: "allow", 2: "allow", 3: "block", 4: "block"}


def test_suffixes_ports_and_addresses(spark):
    hosts = {
        "a.b.example.com": ("com", "example.com"),
        "shop.example.co.kr": ("co.kr", "example.co.kr"),
        "example.gov.uk:8080": ("gov.uk", "example.gov.uk"),
        "me@www.example.cn:80": ("cn", "example.cn"),
        "x.y.host.example": ("host.example", "y.host.example"),
        "co.uk": ("co.uk", "co.uk"),
        "single": ("single", "single"),
        "192.168.9.5:80": (None, "192.168.9.5"),
        "10.0.0.5": (None, "10.0.0.5"),
        "[::1]:80": (None, "[::1]"),
        "": ("", ""),
    }
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = rows.select("host", suffix_of("host", ["host.example"]).alias("s"), domain_of("host", ["host.example"]).alias("d"))
    assert {r.host: (r.s, r.d) for r in got.collect()} == hosts
    # One address tells nothing of another.
    outcomes = spark.createDataFrame([("http://10.0.0.5/", True)] * 50 + [("http://a.net/", False)] * 50, "url string, good boolean")
    pages = spark.createDataFrame([(1, "http://192.168.9.5/"), (2, "http://10.0.0.5/x"), (3, "http://none.example/")], "page_id long, url string")
    bound = {r.page_id: r.reputation for r in judge_urls(pages, outcomes).collect()}
    assert bound[1] == bound[3] < 0.5 < bound[2]


def brute_reputations(outcomes, up):
    """Posteriors by the method of moments; ``up`` gives (domain, suffix or None) of a host."""
    total = sum(good for _, good in outcomes)
    mean = (total + 1) / (len(outcomes) + 2)
    found = {("all", ""): (total + 1, len(outcomes) - total + 1)}
    for level in ("suffix", "domain", "host"):
        units = {}
        for host, good in outcomes:
            domain, suffix = up(host)
            name, above = {"suffix": (suffix, None), "domain": (domain, ("suffix", suffix)), "host": (host, ("domain", domain))}[level]
            if name is not None:
                n, g, _ = units.get(name, (0, 0, None))
                alpha, beta = found.get(above, (mean, 1 - mean))
                units[name] = n + 1, g + good, alpha / (alpha + beta)
        excess = sum((g - n * m) ** 2 - n * m * (1 - m) for n, g, m in units.values() if n > 1)
        scale = sum(n * (n - 1) * m * (1 - m) for n, _, m in units.values() if n > 1)
        strength = 1000.0 if scale <= 0 or excess <= 0 else min(max(scale / excess - 1, 1.0), 1000.0)
        for name, (n, g, m) in units.items():
            found[level, name] = g + strength * m, n - g + strength * (1 - m)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_posteriors_and_verdicts_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rate, outcomes = {}, []
    for _ in range(1500):
        if rng.random() < 0.1:
            host, top = f"10.0.0.{rng.randrange(4)}", "ip"
        else:
            top = rng.choice(["com", "net", "co.uk"])
            host = f"h{rng.randrange(3)}.d{int(rng.expovariate(0.2))}.{top}"
        own = rate.setdefault(host, rng.betavariate(2, 1) if top == "com" else rng.betavariate(1, 2))
        outcomes.append((host, rng.random() < own))

    def up(host):
        labels = host.split(".")
        if labels[0].isdigit():
            return host, None
        n = 2 if host.endswith(".co.uk") else 1
        return ".".join(labels[-n - 1 :]), ".".join(labels[-n:])

    want = brute_reputations(outcomes, up)
    table = spark.createDataFrame([(f"http://{h}/p", g) for h, g in outcomes], "url string, good boolean")
    got = {(r.level, r.name): (r.alpha, r.beta) for r in reputations(table).collect()}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-9), key

    unknown = ["h9.d0.com", "new.other.net", "x.unknown.example", "10.9.9.9", "new.d1.co.uk"]
    hosts = sorted({h for h, _ in outcomes}) + unknown
    pages = spark.createDataFrame([(k, f"http://{h}/q") for k, h in enumerate(hosts)], "page_id long, url string")
    judged = {r.page_id: r for r in judge_urls(pages, table).collect()}
    for k, host in enumerate(hosts):
        domain, suffix = up(host)
        names = [("host", host), ("domain", domain), ("suffix", suffix), ("all", "")]
        alpha, beta = next(want[n] for n in names if n in want)
        n = alpha + beta
        bound = alpha / n - 1.645 * (alpha * beta / (n * n * (n + 1))) ** 0.5
        assert judged[k].reputation == pytest.approx(bound, rel=1e-9)
        assert judged[k].verdict == ("allow" if bound >= 0.5 else "block")


def test_every_page_is_judged_and_strong_hosts_stand_out(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = QUERIES["op6_url_filter"](spark, SF)
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert got.count() == pages.count() == got.select("page_id").distinct().count()
    assert judge_urls(pages.limit(0), spark.createDataFrame([], "url string, good boolean")).count() == 0


# Test items.


def substituted(rng, text, share):
    w = text.split()
    for k in rng.sample(range(len(w)), int(len(w) * share)):
        w[k] = f"swap{k}"
    return " ".join(w)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


def test_overlaps_tolerate_substitutions_and_need_enough_words(spark):
    rng = random.Random(5)
    tests = [(k, passage(k, n)) for k, n in enumerate((8, 13, 20, 40, 80))]
    tests += [(10, None), (11, ""), (12, "too short to tell"), (13, passage(3, 40))]
    docs = list(ODD)
    truth = set()
    for k, text in tests[:5]:
        for how, leaked in enumerate(
            (text, text.upper().replace(" ", ",\n"), substituted(rng, text, 0.1), passage(70 + k, 30) + " " + text)
        ):
            docs.append((100 + 10 * k + how, f"{passage(200 + k, 7)} {leaked} {passage(300 + k, 9)}"))
            truth.add((100 + 10 * k + how, k))
    docs.append((500, " ".join(tests[4][1].split()[:11]) + " " + passage(99, 30)))  # under 13 words of a long item
    docs.append((501, " ".join(tests[4][1].split()[20:36])))  # 16 words from its middle
    truth |= {(501, 4), (12, 4)}
    truth |= {(i, 3) for i in (9, 10, 11)} | {(i, 13) for i, k in truth if k == 3} | {(i, 13) for i in (9, 10, 11)}
    got = contaminated(documents(spark, docs), items(spark, tests)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth
    assert len(got) == len(truth)
    for r in got:
        assert r.n_alike >= 0.8 * r.n_words
    kept = drop_contaminated(documents(spark, docs), items(spark, tests))
    leaked = {i for i, _ in truth}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, _ in docs if i not in leaked)
    assert kept.columns == documents(spark, []).columns


def test_many_test_items_go_in_blocks(spark, monkeypatch):
    tests = [(k, passage(k, 30)) for k in range(40)]
    docs = documents(spark, [(k, f"{passage(900 + k, 5)} {passage(k, 30)}") for k in range(0, 60, 3)])
    whole = {tuple(r) for r in contaminated(docs, items(spark, tests)).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2000)
    assert {tuple(r) for r in contaminated(docs, items(spark, tests)).collect()} == whole
    assert {r[:2] for r in whole} == {(k, k) for k in range(0, 40, 3)}
    assert drop_contaminated(docs, items(spark, tests)).count() == 6


@pytest.mark.parametrize("kind", ["int", "short", "string", "double"])
def test_item_ids_of_any_type_and_repeated_items(spark, monkeypatch, kind):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 10_000)
    tests = items(spark, [(1, passage(1, 20)), (2, passage(2, 20)), (2, passage(2, 20)), (None, passage(3, 20))])
    tests = tests.withColumn("item_id", F.col("item_id").cast(kind))
    many = spark.range(10_000).select(F.lit(7).cast(kind).alias("item_id"), F.lit(passage(7, 20)).alias("text"), F.lit("x").alias("doc_id"))
    docs = documents(spark, [(k, f"{passage(50 + k, 5)} {passage(k, 20)}") for k in range(6)])
    got = contaminated(docs, tests.unionByName(many))
    assert got.schema["item_id"].dataType == tests.schema["item_id"].dataType
    ids = sorted((r.doc_id, r.item_id is None) for r in got.collect())
    assert ids == [(1, False), (2, False), (2, False), (3, True)]
    # Equal items are one block's text, however many rows they have.
    blocks = list(decontamination._blocks(decontamination._items(tests.unionByName(many), "item_id", "text")))
    assert sorted(len(b.ids) for b in blocks) == [4]


def test_no_documents_or_no_items(spark):
    assert contaminated(documents(spark, ODD), items(spark, [])).count() == 0
    assert contaminated(documents(spark, []), items(spark, [(1, passage(1, 20))])).count() == 0
    assert drop_contaminated(documents(spark, ODD), items(spark, [])).count() == len(ODD)


def test_leaks_of_a_whole_table(spark):
    """Documents that hold a test item word for word, by brute force."""
    tests = [(r.item_id, words(r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id) for r in QUERIES["op9_decontamination"](spark, SF).collect()}
    exact = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = f" {' '.join(words(r.text.lower()))} "
        exact |= {(r.doc_id, i) for i, w in tests if f" {' '.join(w)} " in text}
    assert exact and exact <= found
    assert len({d for d, _ in found}) <= len({d for d, _ in exact}) + 2


# Dialogues.


def brute_chat(rows):
    """{(conv, perspective): [(text, is the assistant's)]} in order."""
    dialogues = defaultdict(list)
    for conv, turn, role, text in rows:
        dialogues[conv].append((turn is not None, turn or 0, role or "unknown", text or ""))
    result = {}
    for conv, turns in dialogues.items():
        for who in {r for _, _, r, _ in turns} - {"system"}:
            parts = []
            for _, _, role, text in sorted(turns, key=lambda t: t[:3]):
                head = "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user|> {role}\n"
                parts += [(head, False), (f"{text}<|end|>\n", role == who)]
            result[conv, who] = parts
    return result


CHAT = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", ""), (1, 4, "eve", "🙂 é"),
    (2, 0, "user", "q"), (2, 0, "assistant", "tie"), (2, 1, None, "who"), (2, None, "", "first"),
    (3, 0, "system", "alone"), (None, 0, "user", "no id"), (None, 1, "assistant", "ok"), (4, 5, "user", "x" * 5000),
    (4, 6, "user", "x" * 5000), (4, 6, "user", "x" * 5000),
]


@pytest.mark.parametrize("part_bytes", [1, 40, 1 << 16])
def test_every_participant_is_the_assistant_once(spark, part_bytes):
    schema = "conv_id long, turn long, role string, text string, perspective string, mask string"
    rows = CHAT + [(5, k, f"s{k % 3}", f"turn {k}") for k in range(300)]
    turns = spark.createDataFrame([(*r, "p", "m") for r in rows], schema)
    found = defaultdict(list)
    for r in rotate_perspectives(turns, part_bytes=part_bytes).collect():
        found[r.conv_id, r.perspective].append(r)
    expected = brute_chat(rows)
    assert set(found) == set(expected)
    for key, parts in expected.items():
        own = sorted(found[key], key=lambda r: r.part_no)
        assert "".join(r.text for r in own) == "".join(t for t, _ in parts)
        said = [r.text[m.start : m.start + m.length] for r in own for m in r.mask]
        assert said == [t for t, mine in parts if mine]
        assert sum(r.n_turns for r in own) == len(parts) // 2
        if part_bytes == 1:
            assert len(own) == len(parts) // 2


def test_no_turns_and_plain_functions_only(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert rotate_perspectives(empty).count() == 0
    plan = rotate_perspectives(spark.read.parquet(f"{SF}/conversations.parquet"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text
