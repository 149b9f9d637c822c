import os
import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, bucket int, n int, ids string, t string, component string, n_words string, fail_bits string, n_removed string, sig string, row string, kept string, _row long, _all string, _n_removed string, _m string, _text string, h string, d string, f string, place long, chunk string"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return SF


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}q" for _ in range(n))


def odd_texts():
    """Null, empty, blank, tied, repeated and very long texts."""
    base = words(1, 120)
    return [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, words(2, 60_000)), (7, "x" * 300_000), (None, base), (None, None),
        (8, "\n".join(["same line here"] * 9)), (-5, "é ß <|endoftext|> 日本   " + base), (9, "a"), (10, "a b"), (9007199254740993, base + " tail"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every odd kind, with columns whose names clash with the operators' own."""
    rest = ("clash",)
    rows = [(d, t, None, "s", None, 1, 2, 3, *rest * 9, 7, *rest * 7, 9, "clash") for d, t in odd_texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_sets(texts, size):
    import re

    out = []
    for t in texts:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        out.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    return out


def brute_components(ids, sets):
    parent = list(range(len(ids)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 0.79 * max(len(a), len(b)) <= min(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= 80 * (len(a) + len(b) - shared):
                    parent[root(i)] = root(j)
    least = {}
    for k in range(len(ids)):
        least[root(k)] = min(least.get(root(k), ids[k]), ids[k])
    return [least[root(k)] for k in range(len(ids))]
