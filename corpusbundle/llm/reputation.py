"""URL filter: fixed rules first, else the reputation of the host.

Reputation is empirical Bayes on labelled pages. Each level of names shrinks
towards the level above it: suffix towards all pages, registered domain towards
its suffix, host towards its domain. A level's beta prior has the parent's mean;
its strength comes from how much the units of that level differ beyond chance
(method of moments over the whole table).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbundle.llm.common import durable_table, spread_join

#: Under a country's two letters these labels make a suffix of two labels; a registered
#: domain has one label more than its suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc")

#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(found, upper, lower)


def path_of(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def name_of(host: str) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.col(host), r"\A.*@|:[0-9]*\z", "")


def _is_address(name: Column) -> Column:
    """Digits and dots, or brackets: an address has no labels that names share."""
    return name.rlike(r"\A([0-9.]+|\[.*\])\z")


def _suffix_labels(name: Column, suffixes: Sequence[str]) -> Column:
    """How many labels the suffix has: those of the longest given one, else two or one by rule."""
    ruled = F.substring_index(name, ".", -2).rlike(rf"\A({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}\z")
    found = F.when(ruled, 2).otherwise(1)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        given = [s for s in suffixes if s.count(".") + 1 == n]
        found = F.when(F.substring_index(name, ".", -n).isin(*given), n).otherwise(found)
    return found


def _last_labels(name: Column, n: Column) -> Column:
    labels = F.split(name, r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def suffix_of(host: str, suffixes: Sequence[str] = ()) -> Column:
    """The public suffix of a name, null for an address."""
    name = name_of(host)
    return F.when(~_is_address(name), _last_labels(name, _suffix_labels(name, suffixes)))


def domain_of(host: str, suffixes: Sequence[str] = ()) -> Column:
    """The registered domain, one label more than the suffix; an address is its own."""
    name = name_of(host)
    return F.when(_is_address(name), name).otherwise(_last_labels(name, _suffix_labels(name, suffixes) + 1))


def rule_of(host: str, path: str, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule (verdict, host, path) that fits; else null.

    A rule fits its host and all subdomains where the path starts with the rule's path.
    Of equally long rules the first in the list wins.
    """
    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def one(verdict: str, rule_host: str, rule_path: str) -> tuple[Column, Column]:
        under = (F.col(host) == rule_host) | F.col(host).endswith(f".{rule_host}")
        fits = under & F.col(path).startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        return fits, value

    tests = [one(*r) for r in longest_first]
    if not tests:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    first = F.when(*tests[0])
    return reduce(lambda found, test: found.when(*test), tests[1:], first)


def _strength(units: DataFrame) -> float:
    """Prior strength from (good, n, parent) rows, by the method of moments.

    With unit rates p_i around parents m_i, the excess of the squared deviations over
    binomial noise is n_i m_i (1 - m_i)(n_i - 1) / (strength + 1) in expectation.
    """
    noise = F.col("parent") * (1 - F.col("parent"))
    deviation = F.pow(F.col("good") - F.col("n") * F.col("parent"), F.lit(2)) - F.col("n") * noise
    row = units.filter("n > 1").agg(
        F.sum(deviation).alias("excess"), F.sum(F.col("n") * (F.col("n") - 1) * noise).alias("scale")
    ).first()
    if row.scale is None or row.scale <= 0 or row.excess <= 0:
        return STRONGEST
    return min(max(row.scale / row.excess - 1.0, WEAKEST), STRONGEST)


def reputations(
    outcomes: DataFrame, url_col: str = "url", good_col: str = "good", suffixes: Sequence[str] = ()
) -> DataFrame:
    """One row per level and name: level, name, n, good, and the beta posterior (alpha, beta).

    ``suffixes`` are public suffixes beside those that the rule of ``SECOND_LEVEL`` finds.
    User and port do not count for domain and suffix; an address has no suffix and shrinks
    towards all pages.

    ``outcomes`` holds labelled pages; rows with a null url or outcome tell nothing and
    are left out. The level ``all`` has one row with an empty name, also if there are no
    outcomes: alpha = beta = 1 then.
    """
    host = F.col("host")
    seen = durable_table(
        outcomes.select(host_of(url_col).alias("host"), F.col(good_col).cast("boolean").alias("good"))
        .filter("host != '' and good is not null")
        .groupBy("host")
        .agg(F.sum(F.col("good").cast("double")).alias("good"), F.count(F.lit(1)).cast("double").alias("n"))
        .withColumns({"domain": domain_of("host", suffixes), "suffix": suffix_of("host", suffixes)})
    )
    spark = outcomes.sparkSession
    total = seen.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    good, n = total.good or 0.0, total.n or 0.0
    mean = (good + 1) / (n + 2)
    levels = [
        spark.createDataFrame(
            [("all", "", n, good, good + 1, n - good + 1)],
            "level string, name string, n double, good double, alpha double, beta double",
        )
    ]

    def level(name: str, parents: DataFrame | None, parent_key: str | None) -> DataFrame:
        keys = [name] if parent_key is None else [name, parent_key]
        units = seen.filter(F.col(name).isNotNull()).groupBy(*dict.fromkeys(keys)).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
        if parents is None:
            units = units.withColumn("parent", F.lit(mean))
        else:
            above = parents.select(F.col("name").alias(parent_key), (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("parent"))
            units = units.join(above, parent_key, "left").withColumn("parent", F.coalesce("parent", F.lit(mean)))
        units = durable_table(units)
        strength = F.lit(_strength(units))
        return durable_table(units.select(
            F.lit(name).alias("level"),
            F.col(name).alias("name"),
            "n",
            "good",
            (F.col("good") + strength * F.col("parent")).alias("alpha"),
            (F.col("n") - F.col("good") + strength * (1 - F.col("parent"))).alias("beta"),
        ))

    suffixes = level("suffix", None, None)
    domains = level("domain", suffixes, "suffix")
    hosts = level("host", domains, "domain")
    return reduce(DataFrame.unionByName, [*levels, suffixes, domains, hosts])


def lower_bound(alpha: Column, beta: Column, z: float) -> Column:
    """Mean minus z deviations of a beta posterior."""
    total = alpha + beta
    return alpha / total - z * F.sqrt(alpha * beta / (total * total * (total + 1)))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    least: float = 0.5,
    z: float = 1.645,
    suffixes: Sequence[str] = (),
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, reputation (posterior lower bound).

    A page under a rule gets the rule's verdict. Any other is allowed if the lower
    posterior bound of its host reaches ``least``; a host without labels takes its
    domain's posterior, then its suffix's, then that of all pages (see ``reputations`` for
    ``suffixes``, ports and addresses). A null url, or one
    without ``://``, has an empty host and path, no rule, and the bound of all pages.
    Repeated rows are judged alike, each with its own row. Columns of ``pages`` other
    than the id and the url are not read.
    """
    judged = pages.select(
        F.col(id_col).alias("_id"), host_of(url_col).alias("host"), path_of(url_col).alias("path")
    )
    names = reputations(outcomes, suffixes=suffixes)
    everything = names.filter("level = 'all'").first()

    # Hosts are far fewer than pages, and the partial count leaves one row per task for a hot one.
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("_pages"))
    hosts = hosts.withColumns({"domain": domain_of("host", suffixes), "suffix": suffix_of("host", suffixes)})
    for level in ("suffix", "domain", "host"):
        known = names.filter(F.col("level") == level).select(
            F.col("name").alias(level), F.struct("alpha", "beta").alias(f"_{level}")
        )
        hosts = hosts.join(known, level, "left")
    top = F.struct(F.lit(everything.alpha).alias("alpha"), F.lit(everything.beta).alias("beta"))
    best = F.coalesce("_host", "_domain", "_suffix", top)
    hosts = durable_table(
        hosts.select("host", "_pages", lower_bound(best["alpha"], best["beta"], z).alias("reputation"))
    )
    ruled = F.col("_rule")
    return (
        spread_join(judged, hosts, "host", "_pages")
        .withColumn("_rule", rule_of("host", "path", rules))
        .select(
            F.col("_id").alias(id_col),
            "host",
            "path",
            ruled["rule"].alias("rule"),
            F.coalesce(ruled["verdict"], F.when(F.col("reputation") >= least, "allow").otherwise("block")).alias("verdict"),
            "reputation",
        )
    )
