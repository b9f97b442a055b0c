"""The queries over the corpus tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations
from .decontaminate import contaminated
from .exact_dedup import exact_duplicates
from .jaccard_join import near_duplicates
from .license_scan import scan_licenses
from .mixing import mix_sources
from .quality import quality_report
from .sharding import assign_shards
from .token_count import count_tokens, sentencepiece_vocabulary
from .toxicity import toxicity_report
from .url_filter import judge_urls, labelled_urls
from .vector_near_dups import vector_near_duplicates
from .whitening import whiten

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), labelled_urls(spark))


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), sentencepiece_vocabulary(VOCABULARY))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), lenient=True)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_documents(spark, sf_dir), shards=24)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_embeddings(spark, sf_dir))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_near_duplicates(_embeddings(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_token_count": op2_token_count,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_license_scan": op7_license_scan,
    "op8_quality": op8_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_mixing": op10_mixing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL = {
    "op3_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN e ON r.other = e.x)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
    """,
    "op9_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), w AS (
            SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS place,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id
            FROM n
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM w
    """,
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (SELECT row_number() OVER () AS id, * FROM (SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS w, count(*) AS m FROM pieces GROUP BY ALL)),
        runs AS (
            SELECT lang, m, a, lead(a) OVER next AS b, lead(a, 2) OVER next AS c
            FROM (SELECT id, lang, m, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w) WINDOW next AS (PARTITION BY id ORDER BY i)
        ), f AS (
            SELECT lang, 1 AS words, a AS phrase, sum(m)::BIGINT AS f FROM runs GROUP BY ALL
            UNION ALL SELECT lang, 2, a || ' ' || b, sum(m)::BIGINT FROM runs WHERE b IS NOT NULL GROUP BY ALL
            UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, sum(m)::BIGINT FROM runs WHERE c IS NOT NULL GROUP BY ALL
        ), total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
        c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words >= 2 AND f >= 10),
        longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE words = 3) GROUP BY ALL),
        part AS (SELECT lang || ' ' || phrase AS part, f FROM f WHERE f >= 10),
        cuts AS (
            SELECT c.lang, c.phrase, c.a, k, lang || ' ' || array_to_string(w[1:k], ' ') AS lp, lang || ' ' || array_to_string(w[k + 1 :], ' ') AS rp
            FROM c, (VALUES (1), (2)) AS v(k) WHERE k < words
        ), s AS (
            SELECT cuts.*, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM cuts JOIN part l ON l.part = lp JOIN part r ON r.part = rp
        ), worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        kept AS (SELECT worst.* FROM worst LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 50 * worst.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
    """,
}
