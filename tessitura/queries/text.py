"""Queries with the text-shaped functions: slugs, groups, forms, n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import musical_form, slug, transpose_key
from ..operators import melody, similarity
from .registry import query


@query("SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def slug_url(s):
    return s.table("pages").select("page_id", slug(F.col("url")).alias("slug"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) || ':' || regexp_extract(url, '/([a-z]{2})/', 1) AS work FROM pages")
def group_regex(s):
    return s.table("pages").select("page_id", F.concat_ws(":", F.regexp_extract("url", "^https?://([^/]+)", 1), F.regexp_extract("url", "/([a-z]{2})/", 1)).alias("work"))


@query(
    """SELECT p_partkey, CASE WHEN t LIKE '%prelude%' OR t LIKE '%fugue%' THEN 'prelude_fugue' WHEN t LIKE '%sonata%' THEN 'sonata' WHEN t LIKE '%etude%' THEN 'etude' WHEN t LIKE '%ballade%' THEN 'ballade' ELSE 'other' END AS form
    FROM (SELECT p_partkey, lower(['Prelude and ', 'Piano Sonata ', 'Etudes op.', 'Ballade no', 'Album '][1 + p_partkey % 5] || p_name) AS t FROM part) p"""
)
def form_rules(s):
    heads = F.array(*map(F.lit, ("Prelude and ", "Piano Sonata ", "Etudes op.", "Ballade no", "Album ")))
    title = F.concat(F.element_at(heads, (1 + F.pmod("p_partkey", F.lit(5))).cast("int")), F.col("p_name"))
    return s.table("part").select("p_partkey", musical_form(title).alias("form"))


@query(
    """SELECT p_partkey, k[1 + (list_position(k, t) - 1 + p_size) % 12] || ' ' || m AS key FROM (SELECT p_partkey, p_size, k, k[1 + p_partkey % 12] AS t, CASE WHEN p_partkey % 2 = 0 THEN 'major' ELSE 'minor' END AS m
    FROM part, (SELECT ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'] AS k)) p"""
)
def key_transposition(s):
    from ..functions.scalar import KEY_NAMES

    name = F.element_at(F.array(*map(F.lit, KEY_NAMES)), (1 + F.pmod("p_partkey", F.lit(12))).cast("int"))
    key = F.concat_ws(" ", name, F.when(F.pmod("p_partkey", F.lit(2)) == 0, "major").otherwise("minor"))
    return s.table("part").select("p_partkey", transpose_key(key, F.col("p_size")).alias("key"))


WORDS = r"SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, [x FOR x IN string_split_regex(lower(text), '\s+') IF x <> ''] AS w FROM documents) d"


def _words(s):
    found = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    return s.table("documents").select("doc_id", F.posexplode(found).alias("i", "w"))


@query(
    f"""SELECT doc_id, count(DISTINCT (a, b, c)) / count(*) AS vocabulary_ratio FROM (SELECT doc_id, w AS a, lead(w) OVER x AS b, lead(w, 2) OVER x AS c FROM ({WORDS}) z WINDOW x AS (PARTITION BY doc_id ORDER BY i)) WHERE c IS NOT NULL GROUP BY doc_id""",
    rounds="vocabulary_ratio",
)
def word_trigram_vocabulary(s):
    return melody.ngram_stats(melody.ngrams(_words(s), "w", 3, "doc_id", "i"), "doc_id").select("doc_id", "vocabulary_ratio")


@query(
    """WITH w AS (SELECT conv_id, role, unnest([x FOR x IN string_split(text, ' ') IF x <> '']) AS w FROM conversations), a AS (SELECT conv_id, w, count(*) AS n FROM w WHERE role = 'user' GROUP BY ALL), b AS (SELECT conv_id, w, count(*) AS n FROM w WHERE role <> 'user' GROUP BY ALL)
    SELECT conv_id, sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) / sum(greatest(coalesce(a.n, 0), coalesce(b.n, 0))) AS jaccard FROM a FULL JOIN b USING (conv_id, w) GROUP BY conv_id""",
    rounds="jaccard",
)
def role_word_jaccard(s):
    words = s.table("conversations").select("conv_id", "role", F.explode(F.filter(F.split("text", " "), lambda x: x != "")).alias("w"))
    return similarity.multiset_jaccard(words.where("role = 'user'"), words.where("role <> 'user'"), ["w"], "conv_id").select("conv_id", "jaccard")
