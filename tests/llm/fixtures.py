"""Small corpora with awkward rows, and plain versions of the word rules."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long, sig long, n int, hash long, norm string, row long, size double, s string, copy int"
EXTRA = (7, 7, 7, "x", 7, 0.5, "y", 1)


def words(text):
    return (text or "").encode().lower().split()


def corpus(seed=0, n=60):
    """Rows (doc_id, text, lang, source): copies, near copies, shared passages."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = prose(60)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not rows:
            text = prose(rng.randint(8, 120))
        elif kind == 1:
            text = rng.choice(rows)[1]
        elif kind in (2, 3):
            w = (rng.choice(rows)[1] or "a b c d e f").split()
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            text = " ".join(w)
        elif kind == 4:
            text = prose(20) + " " + passage + " " + prose(rng.randint(2, 40))
        else:
            text = (" \n" if i % 2 else "\t ").join(prose(rng.randint(1, 9)).split())
        rows.append((i, text, rng.choice(("en", "de", None)), rng.choice(("a", "b", "c", None))))
    return rows


AWKWARD = [
    (1000, None, None, None), (1001, "", "en", "a"), (1002, " \t\n", "en", "a"), (1003, "One", "en", "b"), (1004, "ONE", "en", "b"), (None, "one two three four five six", None, None),
    (None, "one two three four five six", None, None), (1005, "one two three four five six", "en", "c"), (1005, "one two three four five six", "en", "c"), (1006, " é x", "fr", "c"),
    (1007, "lang " * 30_000, "de", "a"), (1008, "x" * 200_000, "de", "a"), (1009, "a\x00b \U0001f600", "en", "b"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *EXTRA) for r in rows], DOC)
