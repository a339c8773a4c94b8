"""The operators of this package over the supplied tables, and plain SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbundle.llm.balance import mix
from corpusbundle.llm.chat import rotate_perspectives
from corpusbundle.llm.common import table, text_of
from corpusbundle.llm.decontamination import contaminated
from corpusbundle.llm.exact import exact_duplicates
from corpusbundle.llm.language_model import score_texts
from corpusbundle.llm.packing import pack
from corpusbundle.llm.phrases import mine_phrases
from corpusbundle.llm.quality import in_fold, train, with_scores
from corpusbundle.llm.reputation import judge_urls
from corpusbundle.llm.retrieval import search
from corpusbundle.llm.simhash import near_duplicates
from corpusbundle.llm.substring import drop_repeated_windows
from corpusbundle.llm.token_counts import count_tokens
from corpusbundle.operators.durable import shared_dir

#: Fixed values of the query: (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_duplicates(docs, carry=[F.sha2(text_of("text"), 256).alias("text_sha256")])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_windows(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the tables carry one id space, so a page's outcome is the label of its id."""
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("good")
    )
    outcomes = pages.select("page_id", "url").join(labels, "page_id")
    return judge_urls(pages, outcomes, URL_RULES)


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), ~in_fold("doc_id", 7, 2))
    return scored.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score", "n_bytes",
    )


#: Fixed value of the query.
QUALITY_THRESHOLD = 0.3


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(~in_fold("doc_id", 5, 0)))
    return with_scores(docs, model).select(
        "doc_id",
        in_fold("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache each time, so that the query does its whole work."""
    cache = f"{shared_dir(spark)}/token-counts/{uuid.uuid4().hex}"
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    counted = count_tokens(table(spark, sf_dir, "documents"), tokenizer, cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "rate", "copies"
    )


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_simhash": op3_simhash,
    "op4_chat_format": op4_chat_format,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_lm_scores": op7_lm_scores,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_source_mix": op11_source_mix,
    "op12_phrases": op12_phrases,
    "op13_ranked_search": op13_ranked_search,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_phrases": rf"""
        WITH pieces AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
            FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
                FROM documents
            )
        ),
        totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang),
        counts AS (
            SELECT lang, array_to_string(list_slice(words, i, i + k - 1), ' ') AS phrase, k, count(*) AS f
            FROM pieces, unnest(range(1, 6)) AS sizes(k), unnest(range(1, len(words) - k + 2)) AS places(i)
            GROUP BY ALL
            HAVING count(*) >= 100
        ),
        candidates AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS words FROM counts WHERE k > 1),
        covered AS (
            SELECT lang, array_to_string(list_slice(words, i, i + j - 1), ' ') AS phrase, max(f) AS longer
            FROM candidates, unnest(range(2, k)) AS sizes(j), unnest(range(1, k - j + 2)) AS places(i)
            GROUP BY ALL
        ),
        cuts AS (
            SELECT lang, phrase, f AS a, j, array_to_string(words[:j], ' ') AS head, array_to_string(words[j + 1:], ' ') AS tail
            FROM candidates LEFT JOIN covered USING (lang, phrase), unnest(range(1, k)) AS places(j)
            WHERE coalesce(longer < f, true)
        ),
        scored AS (
            SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, n, j,
                   ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts
            JOIN counts x ON x.lang = cuts.lang AND x.phrase = head
            JOIN counts y ON y.lang = cuts.lang AND y.phrase = tail
            JOIN totals ON totals.lang = cuts.lang
        ),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM lowest
        QUALIFY rank <= 2000
    """,
    "op13_ranked_search": rf"""
        WITH texts AS (
            SELECT row_number() OVER () AS place, doc_id,
                   regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ),
        sizes AS (SELECT count(*) AS big_n, sum(len(terms))::BIGINT AS big_l FROM texts WHERE len(terms) > 0),
        counts AS (
            SELECT place, doc_id, term, count(*) AS tf, any_value(n) AS n
            FROM (SELECT place, doc_id, len(terms) AS n, unnest(terms) AS term FROM texts)
            GROUP BY place, doc_id, term
        ),
        weights AS (
            SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w
            FROM counts, sizes GROUP BY term
        ),
        wanted AS (
            SELECT place, item_id, term, count(*) AS times
            FROM (
                SELECT row_number() OVER () AS place, item_id,
                       unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM benchmark
            )
            GROUP BY ALL
        ),
        scores AS (
            SELECT q.place AS item, item_id, c.place AS doc, doc_id,
                   sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
            FROM wanted q JOIN counts c USING (term) JOIN weights USING (term), sizes
            GROUP BY ALL
        )
        SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score
        FROM scores WHERE score > 0
        WINDOW best AS (PARTITION BY item ORDER BY score DESC, doc_id, doc)
        QUALIFY row_number() OVER best <= 10
    """,
}
