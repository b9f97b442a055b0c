"""URL filters: host rules first, then logistic regression on hashed n-grams.

A URL's features are the hashed character n-grams of its host and of its path,
each by its share. The regression is fitted on a small labelled table, as
sparse vectors. Scores are DataFrame expressions; the weights are constant
arrays of fixed length in the plan. No page content is read, nothing is
shuffled.
"""

from __future__ import annotations

import hashlib

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
SIZES = (3, 4, 5)
#: A gram's share is of this many at least: in short texts one collision would outweigh all else.
LEAST_GRAMS = 48

#: rule -> verdict; a rule is a domain, with all its subdomains, and a path prefix.
RULES: dict[str, str] = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}

#: What the labelled table is made from: subjects of sites, and the categories of
#: public blocklists (gambling, adult, drugs, loans, pirated software, fakes,
#: phishing, advertising), with words that go with them.
WANTED = (
    "news", "docs", "wiki", "library", "museum", "science", "history", "garden", "recipes", "travel", "weather", "journal", "school", "music", "books", "football",
    "city", "health", "theatre", "nature", "research", "university", "forum", "photo", "cooking", "parents", "market", "energy", "bank", "railway", "church", "software",
)
UNWANTED = (
    "casino", "poker", "slots", "jackpot", "betting", "lottery", "roulette", "gamble", "adult", "porn", "xxx", "escorts", "webcam", "hookup", "erotic", "nude",
    "pills", "pharma", "viagra", "steroids", "loans", "payday", "forex", "credits", "warez", "cracks", "keygen", "torrents", "replica", "phishing", "adserver", "popunder",
)
WANTED_WITH = ("", "today", "online", "world", "guide", "club", "archive", "open")
UNWANTED_WITH = ("", "win", "bonus", "free", "cheap", "online", "deals", "now")
ENDINGS = ("com", "net", "org", "info", "io", "co.uk", "eu", "site")


def made_name(n: int) -> str:
    """A name without meaning, of two or three syllables."""
    draw = hashlib.sha256(str(n).encode()).digest()
    syllable = lambda i: "bcdfghjklmnprstvw"[draw[i] % 17] + "aeiou"[draw[i + 1] % 5] + ("", "n", "r", "s", "l", "th")[draw[i + 2] % 6]
    return "".join(syllable(3 * i + 1) for i in range(2 + draw[0] % 2))


def labelled_names() -> list[tuple[str, int, str]]:
    """(name, block, the word it is made from); made-up names count as wanted."""
    names = [(name, 0, name) for name in map(made_name, range(160))]
    for block, firsts, seconds in ((0, WANTED, WANTED_WITH), (1, UNWANTED, UNWANTED_WITH)):
        for i, first in enumerate(firsts):
            for j, second in enumerate(seconds):
                parts = (first, second) if (i + j) % 2 else (second, first)
                names.append((("-" if j // 2 % 2 else "").join(x for x in parts if x), block, first))
    return names


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, block, word): names of each label, each under several subdomains,
    endings and paths. Those and hyphens come on all sides alike, so that the
    names tell them apart."""
    rows = []
    for n, (name, block, word) in enumerate(labelled_names()):
        for v, sub in enumerate(("", "www.", "blog.", "m.")):
            path = ("/", f"/{made_name(n)}/{n}", f"/2021/{1 + n % 12}/{made_name(n + v)}.html", "/index.html", f"/p/{n}", f"/{made_name(n + 7)}", "")[(n + v) % 7]
            rows.append((f"https://{sub}{name}.{ENDINGS[(n + 3 * v) % len(ENDINGS)]}{path}", block, word))
    return spark.createDataFrame(rows, "url string, block int, word string")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    empty for null or if there is no ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(of_host: Column, of_path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null; equal lengths: the first by name."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        domain, _, rest = rule.partition("/")
        fits = ((of_host == domain) | of_host.endswith("." + domain)) & of_path.startswith("/" + rest)
        found = F.coalesce(found, F.when(fits, F.lit(rule)))
    return found


def grams(text: Column, field: str) -> Column:
    """Buckets of the character n-grams of ``^text$``, several sizes."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(marked, i, F.lit(n)))

    every = [of_size(n) for n in SIZES]
    return F.transform(F.concat(*every), lambda g: F.pmod(F.xxhash64(F.lit(field), g), F.lit(BUCKETS)).cast("int"))


@dataclass
class UrlModel:
    """Weights by bucket of the host's and the path's n-grams; the last weight
    is that of what a short text lacks to :data:`LEAST_GRAMS`."""

    host: list[float]
    path: list[float]
    bias: float


def fit_urls(labelled: DataFrame) -> UrlModel:
    """Fitted on (url, block 0 or 1); other labels and other columns don't
    matter. Without labels of both kinds, every URL scores label 1's share, and
    0 if there are none at all."""
    known = labelled.where(F.col("block").isin(0, 1)).select(F.col("url").cast("string"), F.col("block").cast("double").alias("label"))
    kinds = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        flat = [0.0] * (BUCKETS + 1)
        return UrlModel(flat, flat, 40.0 if 1.0 in kinds else -40.0)

    def words(field: str, text: Column) -> Column:
        found = grams(text, field)
        lacks = F.greatest(F.lit(LEAST_GRAMS) - F.size(found), F.lit(0))
        return F.concat(F.transform(found, lambda b: b.cast("string")), F.array_repeat(F.lit("-"), lacks))

    ready = known.select("url", "label", words("h", host(F.col("url"))).alias("h"), words("p", path(F.col("url"))).alias("p"))
    vocabulary = [*map(str, range(BUCKETS)), "-"]
    for field in ("h", "p"):
        ready = CountVectorizerModel.from_vocabulary(vocabulary, field, f"{field}_counts").transform(ready)
        ready = Normalizer(inputCol=f"{field}_counts", outputCol=f"{field}_shares", p=1.0).transform(ready)
    ready = VectorAssembler(inputCols=["h_shares", "p_shares"], outputCol="features").transform(ready)
    ready = ready.select("label", "features", "url").repartition(1).sortWithinPartitions("url", "label")  # a small labelled table
    model = LogisticRegression(regParam=1e-6, maxIter=12, standardization=False, tol=1e-7).fit(ready)  # stopped early, for words not seen
    weights = [float(w) for w in model.coefficients]
    return UrlModel(weights[: BUCKETS + 1], weights[BUCKETS + 1 :], float(model.intercept))


def block_score(of_host: Column, of_path: Column, model: UrlModel) -> Column:
    """Probability that the URL is unwanted."""

    def part(text: Column, field: str, weights: list[float]) -> Column:
        w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to a constant
        buckets = grams(text, field)
        lacks = F.greatest(F.lit(LEAST_GRAMS) - F.size(buckets), F.lit(0))
        total = F.aggregate(buckets, lacks * F.lit(weights[-1]), lambda a, b: a + F.element_at(w, b + 1))
        return total / (F.size(buckets) + lacks)

    return 1 / (1 + F.exp(-(part(of_host, "h", model.host) + part(of_path, "p", model.path) + F.lit(model.bias))))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: dict[str, str] | None = None, at: float = 0.5) -> DataFrame:
    """Judge the url of every row of ``pages`` (page_id, url).

    A null url, or one without ``://``, has an empty host and path, fits no
    rule and is judged like others. Other columns are ignored; rows may repeat.
    Without labels in ``labelled`` the regression allows every URL.

    Returns page_id, host, path, rule (or null), verdict (the rule's, else
    ``block`` for a score of ``at`` or more), score.
    """
    rules = RULES if rules is None else rules
    model = fit_urls(labelled)
    parted = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    scored = parted.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), block_score(F.col("host"), F.col("path"), model).alias("score"))
    verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else F.lit(None).cast("map<string,string>")
    own = F.when(F.col("score") >= at, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(verdicts[F.col("rule")], own).alias("verdict"), "score")
