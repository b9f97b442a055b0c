"""Operators by row: URLs, tokens, licences, shards, mixes: against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessitura.llm import license_scan, mixing, sharding, token_count, url_filter
from tests.llm.fixtures import AWKWARD, corpus, frame

URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x#y", "https://example.org/en/2", "http://x.com/fr/9", "http://com/de/1", "http://notcom/de/1", "http://x.com/de", "http://x.com?fr/", "http://x.net#/a",
    None, "", "no scheme", "://", "a://b://c/d", "http://spam-farm.example.net/en/7", "http://www.Casino-win.example.net/q", "http://museum.example.net/fr/3/", "http://ÉX.net/É", "http://x\ny.net/a\nb?c", "http://" + "a" * 5000 + ".net/" + "b" * 5000,
]


def plain_url(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return m[2].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[3]


def plain_rule(host, path):
    fits = [r for r in url_filter.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


@pytest.fixture(scope="module")
def judged(spark):
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate(URLS)] + [(None, URLS[0], "h", "r", 1), (0, URLS[0], "h", "r", 1)], "page_id long, url string, host string, rule string, score int")
    return url_filter.judge_urls(pages, url_filter.labelled_urls(spark))


def test_urls_are_parted_and_ruled(judged):
    rows = judged.collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        url = URLS[r.page_id or 0]
        assert (r.host, r.path) == plain_url(url), url
        assert r.rule == plain_rule(r.host, r.path)
        assert r.verdict == url_filter.RULES.get(r.rule, "block" if r.score >= 0.5 else "allow")


def test_the_regression_knows_its_labels(spark, judged):
    labels = url_filter.labelled_urls(spark)
    scored = url_filter.judge_urls(labels.selectExpr("block AS page_id", "url"), labels, {}).collect()
    assert all((r.score >= 0.5) == bool(r.page_id) and r.rule is None for r in scored)


def test_the_regression_on_words_it_has_not_seen(spark):
    """Three folds by whole words; figures are in the README."""
    labels = url_filter.labelled_urls(spark).withColumn("fold", url_filter.F.expr("pmod(xxhash64(word), 3)")).cache()
    hit = Counter()
    for fold in range(3):
        pages = labels.where(f"fold = {fold}").selectExpr("block AS page_id", "url")
        for r in url_filter.judge_urls(pages, labels.where(f"fold <> {fold}"), {}).collect():
            hit[r.page_id, r.verdict] += 1
    found, wrong = hit[1, "block"] / (hit[1, "block"] + hit[1, "allow"]), hit[0, "block"] / (hit[0, "block"] + hit[0, "allow"])
    print(f"unseen words: found {found:.3f}, wrongly blocked {wrong:.3f}")
    assert found > 0.6 and wrong < 0.15


def test_scores_against_a_plain_scorer(spark):
    model = url_filter.fit_urls(url_filter.labelled_urls(spark))
    urls = [u for u in URLS if u and "é" not in u.lower()]
    got = {r.url: r for r in spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_filter.host(url_filter.F.col("url")).alias("h"), url_filter.path(url_filter.F.col("url")).alias("p"))
           .select("*", url_filter.block_score(url_filter.F.col("h"), url_filter.F.col("p"), model).alias("score")).collect()}
    texts = {(f, g) for r in got.values() for f, t in (("h", r.h), ("p", r.p)) for n in url_filter.SIZES for g in [("^" + t + "$")[i : i + n] for i in range(max(len(t) + 2 - n + 1, 1))]}
    bucket = {(r.f, r.g): r.b for r in spark.createDataFrame(sorted(texts), "f string, g string").selectExpr("f", "g", f"pmod(xxhash64(f, g), {url_filter.BUCKETS}) AS b").collect()}
    for u in urls:
        z = model.bias
        for f, t, w in (("h", got[u].h, model.host), ("p", got[u].p, model.path)):
            of = [bucket[f, ("^" + t + "$")[i : i + n]] for n in url_filter.SIZES for i in range(max(len(t) + 2 - n + 1, 1))]
            lacks = max(url_filter.LEAST_GRAMS - len(of), 0)
            z += (sum(w[b] for b in of) + lacks * w[-1]) / (len(of) + lacks)
        assert got[u].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


@pytest.mark.parametrize(("blocks", "verdict"), [([], "allow"), ([None, None], "allow"), ([0, 0], "allow"), ([1, 1, None], "block")])
def test_urls_without_labels_of_both_kinds(spark, blocks, verdict):
    labels = spark.createDataFrame([(f"http://x{i}.net/", b) for i, b in enumerate(blocks)], "url string, block int")
    pages = spark.createDataFrame([(1, "http://casino.net/x"), (2, None), (3, "http://a.org/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, labels).collect()}
    assert got == {1: verdict, 2: verdict, 3: "allow"}


def test_urls_need_no_python(judged):
    assert not re.search("Python|Pandas|Arrow|Exchange", judged._jdf.queryExecution().toString())


PIECES = ["▁", "▁a", "▁ab", "▁abc", "a", "b", "c", "bc", "bcd", "cd", "d", "de", "▁x", "xyz", "x", "y"]


def greedy(word, pieces):
    rest, n = "▁" + word, 0
    while rest:
        k = next((k for k in range(len(rest), 0, -1) if rest[:k] in pieces), 0)
        if not k:
            return 1
        rest, n = rest[k:], n + 1
    return n


@settings(max_examples=400, deadline=None)
@given(st.sets(st.text("abcdxyz", min_size=1, max_size=4), min_size=1, max_size=12), st.sets(st.text("abcdxyz", max_size=3), max_size=6), st.text("abcdxyzq", min_size=1, max_size=14))
def test_automaton_against_longest_match_first(inner, first, word):
    pieces = inner | {"▁" + p for p in first}
    automaton = token_count.LongestMatch(sorted(pieces))
    if not first:
        assert automaton.count(word) == 1
        return
    # A piece of START alone or more must begin the word.
    assert automaton.count(word) == greedy(word, pieces)


def test_token_counts(spark):
    got = token_count.count_tokens(frame(spark, [(1, "abcde abc\tq", "en", "a"), *AWKWARD]), PIECES).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(AWKWARD) + 1 and (by[1].n_words, by[1].n_tokens) == (3, greedy("abcde", PIECES) + 1 + 1)
    assert (by[1000].n_words, by[1000].n_tokens) == (0, 0) and by[1007].n_words == 30_000 and by[1008].n_tokens == 200_000
    assert token_count.count_tokens(frame(spark, []), PIECES).count() == 0


def test_a_real_vocabulary_agrees_with_longest_match(spark):
    path = "/opt/tokenizers/piece_bpe_32k.model"
    try:
        pieces = token_count.sentencepiece_vocabulary(path)
    except OSError:
        pytest.skip("no vocabulary here")
    automaton, known = token_count.LongestMatch(pieces), set(pieces)
    for text in (r[1] for r in corpus(4, 30) + [(0, "the Reëntrant naïve 漢字 antidisestablishmentarianism x1y2")]):
        for word in text.split():
            assert automaton.count(word) == greedy(word, known)


def plain_words(t):
    return [w for w in (x.strip(license_scan.EDGES) for x in t.encode().lower().split()) if w]


def plain_dice(a, b):
    """(shared, dice) of word lists."""
    p, q = set(zip(a, a[1:], strict=False)), set(zip(b, b[1:], strict=False))
    return (len(p & q), 2 * len(p & q) / (len(p) + len(q))) if p and q else (0, 0.0)


def plain_license(text):
    """The likest licence over segments and all runs of words."""
    found, words = [], plain_words(text)
    parts = [plain_words(p.decode()) for _, p in license_scan.segments(text.encode())]
    for name, t in license_scan.TEMPLATES:
        of = plain_words(t)
        for part in parts + [words[i : i + len(of)] for i in range(len(words) - len(of) + 1)]:
            shared, dice = plain_dice(part, of)
            if dice >= license_scan.THRESHOLD:
                found.append((-shared, -dice, name))
    return min(found, default=None)


BSD2 = f"{license_scan._BSD_OPENS}\n\n{license_scan._BSD_CLAUSES}\n\n{license_scan._BSD_ENDS}"
LICENSED = [
    (1, "intro\nReleased under the MIT License.\nmore text here", "en", "a"), (2, "Licensed under CC BY-NC 4.0!", "en", "a"), (3, "this work is licensed under the gnu general public license, version 3", "en", "a"),
    (4, "This is free and unencumbered\nsoftware released into the public domain.\n\nother", "en", "a"), (5, "nothing of the kind", "en", "a"), (6, "Licensed under the Apache Licence, Version 2.0.", "en", "a"),
    (7, "we said that it is Released under the MIT License. and went on for a while in one line", "en", "a"), (8, "# " + license_scan._MIT.replace("Software", "\n# Software").replace(", ", ",\n#  "), "en", "a"),
    (9, "Copyright (c) 2020 A. Person\n" + BSD2, "en", "a"), (10, "x y\n" + BSD2.replace("THIS SOFTWARE", license_scan._BSD_NAMES + "\nTHIS SOFTWARE", 1), "en", "a"), (11, "in a long line of prose " + license_scan._ZLIB + " and more", "en", "a"), (12, "released under the released under the released under", "en", "a"),
]


def test_licenses_against_every_template(spark):
    rows = LICENSED + [(100 + r[0], *r[1:]) for r in corpus(5, 12)] + AWKWARD
    got = license_scan.scan_licenses(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc_id, text, *_ in LICENSED:
        want = plain_license(text)
        assert (by[doc_id].license, by[doc_id].dice) == ((want[2], pytest.approx(-want[1])) if want else (None, None)), doc_id
    assert [by[i].license for i in range(7, 12)] == ["mit", "mit", "bsd-2-clause", "bsd-3-clause", "zlib"]
    assert by[1].line == 1 and by[9].line == 1 and by[3].license == "gpl-3.0" and by[4].license == "unlicense" and by[5].license is None and by[5].n_notices == 0
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0


def test_shards_are_full_gapless_and_follow_the_ring(spark):
    rows = corpus(6, 200) + AWKWARD + [(2000 + i, "the same text", "en", "a") for i in range(150)]
    got = sharding.assign_shards(frame(spark, rows), shards=24).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(24))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    again = sharding.assign_shards(frame(spark, rows).repartition(7), shards=24).collect()
    assert Counter(map(repr, got)) == Counter(map(repr, again))
    assert sharding.assign_shards(frame(spark, [])).count() == 0
    assert len(sharding.assign_shards(frame(spark, rows[:3])).collect()) == 3


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 39), st.integers(1, 30)), st.integers(1, 8))
def test_overflow_continues_clockwise(counts, shards):
    nodes = sharding.ring(shards, 40 // shards)
    counts = {a % len(nodes): n for a, n in counts.items()}
    plan = sharding.overflow_plan(counts, nodes, shards)
    load = Counter()
    for arc, n in counts.items():
        parts = sorted((low, high) for a, low, high, *_ in plan if a == arc)
        assert parts[0][0] == 0 and parts[-1][1] == n and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
    for _, low, high, shard, slot in plan:
        assert slot == load[shard]
        load[shard] += high - low
    if counts:
        assert max(load.values()) - min(load[s] for s in range(shards)) <= 1


def test_one_more_shard_moves_few_rows():
    owner = lambda shards: {p: s for p, s in sharding.ring(shards, 64)}
    kept = sum(owner(25).get(p) == s for p, s in owner(24).items())
    assert kept >= 0.97 * 24 * 64


def plain_targets(sizes, share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {s: 0.0 for s in names}, share * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        unit = left / sum(weight[s] for s in free)
        left = 0.0
        for s in sorted(free, key=str):
            target[s] += unit * weight[s]
        for s in sorted(free, key=str):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.discard(s)
    return target


@pytest.mark.parametrize("seed", [7, 8])
def test_mix_meets_its_targets(spark, seed):
    rows = corpus(seed, 400) + AWKWARD[:7] + [(3000 + i, "word " * 40, "en", "d") for i in range(200)]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    source = defaultdict(list)
    for i, t, _, s in rows:
        source[i].append((s, len((t or "").encode().split())))
    sizes = Counter()
    for i, t, _, s in rows:
        sizes[s] += len((t or "").encode().split())
    target, taken = plain_targets(sizes), Counter()
    for r in got:
        s = next(s for s, n in source[r.doc_id] if n == r.size)
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s], abs=1e-6) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, want in target.items():
        assert taken[s] == math.floor(want + 0.5)
    again = mixing.mix_sources(frame(spark, rows).repartition(5)).collect()
    assert Counter(map(repr, got)) == Counter(map(repr, again))


def test_mix_against_the_schedule_played_slot_by_slot(spark):
    rows = [r for r in corpus(9, 150) if r[3] is not None]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in mixing.mix_sources(df).collect()}
    order = {r.doc_id: r.o for r in df.selectExpr("doc_id", "xxhash64(11, doc_id) AS o").collect()}
    cells = max(64, 2 * 4)
    streams = defaultdict(list)
    for i, _, _, s in sorted(rows, key=lambda r: (order[r[0]] % cells, order[r[0]])):
        streams[s] += [i] * got[i].size
    plan, low = [], 0
    for s in sorted(streams):
        total, goal = len(streams[s]), math.floor(next(got[i].target for i, _, _, x in rows if x == s) + 0.5)
        blocks = math.ceil(total / mixing.LEAST_BLOCK)
        # The blocks in turn, until their words reach the goal.
        parts = []
        while goal:
            k = len(parts) % blocks
            parts.append(streams[s][k * total // blocks : (k + 1) * total // blocks][:goal])
            goal -= len(parts[-1])
        plan.append((low, low + len(parts), s, parts))
        low += len(parts)
    ranks, taken, first = Counter(), Counter(), {}
    played = [next((s, p) for a, z, s, p in plan if a <= (j * mixing.GOLDEN) % 1.0 * low < z) for j in range(low)]
    for s, parts in played + [(s, p) for a, z, s, p in plan for _ in p]:  # what is missing follows
        if ranks[s] < len(parts):
            taken.update(parts[ranks[s]])
            for i in parts[ranks[s]]:
                first.setdefault(i, len(first))
        ranks[s] += 1
    assert {i: r.taken for i, r in got.items()} == {i: taken[i] for i in got}
    placed = sorted((r.first_slot, i) for i, r in got.items() if r.first_slot is not None)
    assert {i for _, i in placed} == set(first)
    blocks_of = [s for s, _ in placed]
    assert [first[i] for _, i in placed] == sorted(first[i] for _, i in placed) or len(set(blocks_of)) < len(blocks_of)


def test_every_small_source_meets_its_target(spark):
    rows = [(i, " ".join(f"x{k}" for k in range(30)), "en", f"s{i:02}") for i in range(40)]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    assert all(r.taken == math.floor(r.target + 0.5) > 0 and r.first_slot is not None for r in got)
    assert abs(sum(r.taken for r in got) - 1800) <= 40


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    got = mixing.mix_sources(frame(spark, AWKWARD[:3])).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 3
