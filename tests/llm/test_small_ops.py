"""Quality rules, line dedup, decontamination, toxicity, HTML."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import decontaminate as D
from scriptloom.llm import html as H
from scriptloom.llm import linededup as L
from scriptloom.llm import quality as Q
from scriptloom.llm import toxicity as X

from .conftest import odd_texts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark, odd):
    extra = [(90, "a b c a b c"), (91, "a a a a"), (92, "a a a"), (93, "x#y|z\n\nx#y|z\n x#y|z"), (94, "to be or to be or not to be"), (95, "a\x0bb\x1cc d")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    found = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in Q.verdicts(docs).collect())
    expected = Counter()
    for d, t in odd_texts() + extra:
        m = brute_quality(t)
        expected[(d, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert found == expected


def test_policies_and_ablation(spark):
    docs = spark.createDataFrame([(1, words(1, 80)), (2, "short"), (3, " ".join(f"{x}#" for x in words(3, 80).split())), (4, "# #"), (5, words(5, 60).upper())], "doc_id long, text string")
    book = Q.ledger(docs).cache()
    kept = lambda v: {r["doc_id"] for r in Q.apply_policy(book, v).filter("kept").collect()}
    assert kept("base") == {1, 3, 5} and kept("v1") == {1}
    table = {r["rule"]: (r["n_failed"], r["n_only"], r["n_documents"]) for r in Q.ablation(book, "v1").collect()}
    assert table["too_few_words"] == (2, 1, 5) and table["symbols_per_word"] == (2, 1, 5) and table["shouting"] == (1, 1, 5)
    for name in Q.POLICIES["v1"]:
        mask = Q.policy_mask("v1") & ~next(1 << r.bit for r in Q.RULES if r.name == name)
        without = book.filter(F.col("fail_bits").bitwiseAND(mask) == 0).count()
        assert without - len(kept("v1")) == table[name][1]


def test_filter_keeps_columns(odd, nothing):
    out = Q.keep_documents(odd)
    assert out.columns == odd.columns and {r["doc_id"] for r in out.collect()} >= {1, 2}
    assert all(r["n_words"] == "clash" for r in out.collect())
    assert Q.verdicts(nothing).count() == 0 and Q.keep_documents(nothing).count() == 0


def test_labelled_quality(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = Q.verdicts(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").filter("NOT base_failed")
    assert out.filter("quality = 1 AND NOT kept").count() == 0 and out.filter("quality = 0 AND kept").count() == 0


# ---- lines -----------------------------------------------------------------


def brute_lines(docs):
    """doc_id -> text after removal, windows seen in (doc_id, line) order."""
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda x: x[0]):
        if text is None:
            out[d] = None
            continue
        lines = text.split("\n")
        kept = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for a, b, c in zip(kept, kept[1:], kept[2:], strict=False):
            w = tuple(lines[k].strip(" \t\n\x0b\x0c\r") for k in (a, b, c))
            gone |= set(range(a, c + 1)) if w in seen else set()
            seen.add(w)
        out[d] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(spark):
    import random

    rng = random.Random(2)
    docs = [(k, "\n".join(rng.choice(["a", "b ", " c", "", "d", "e f"]) for _ in range(rng.randrange(0, 14)))) for k in range(120)]
    docs += [(500, None), (501, ""), (502, "a\nb"), (503, "\n".join(["z"] * 40))]
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    expected = brute_lines(docs)
    assert {k: v for k, (v, _) in found.items()} == expected
    assert found[503] == ("z", 39) and found[500] == (None, 0)


def test_line_dedup_of_texts_under_one_id(spark):
    """Different texts under one id count as one document in the order of their text hashes."""
    texts = ["a\nb\nc\nd", "b\nc\nd\ne", "x\na\nb\nc"]
    docs = spark.createDataFrame([(1, t) for t in texts] + [(2, "a\nb\nc")], "doc_id long, text string")
    order = [r["text"] for r in docs.filter("doc_id = 1").orderBy(F.xxhash64("text")).collect()]
    after = brute_lines([(k, t) for k, t in enumerate(order)] + [(9, "a\nb\nc")])
    assert Counter(r["text"] for r in L.dedup_lines(docs).collect()) == Counter(after.values())


def test_line_dedup_of_long_documents(spark):
    """Many separate spans in one long document, which must not take quadratic time."""
    shared = [f"shared {k} a\nshared {k} b\n\nshared {k} c" for k in range(20_000)]
    docs = [(1, "\n".join(shared)), (2, "\n".join(f"own {k}\n{x}" for k, x in enumerate(shared))), (3, "\n".join(shared[:2]))]
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {1: (docs[0][1], 0), 2: ("\n".join(f"own {k}" for k in range(20_000)), 80_000), 3: ("", 8)}


def test_line_dedup_on_odd_documents(odd, nothing):
    out = L.dedup_lines(odd)
    assert out.columns == [*[c for c in odd.columns if c != "n_removed"], "n_removed"] and out.count() == odd.count()
    assert {r["text"] for r in out.filter("doc_id = 8").collect()} == {"same line here"}
    assert L.dedup_lines(nothing).count() == 0


# ---- decontamination -------------------------------------------------------


def test_matches(spark):
    items = [(1, words(50, 40)), (2, words(51, 30).upper()), (3, "tiny"), (4, None), (5, "the quick brown fox jumps over it all day")]
    p = items[0][1]
    edited = p[:40] + "#" + p[41:120] + p[121:]
    docs = [(10, words(60, 300)), (11, words(61, 50) + " " + p + " tail"), (12, "x " + edited), (13, p[50:140]), (14, p[50:110]), (15, None), (16, ""), (17, items[1][1].lower().replace(" ", "\n")), (18, "so tiny"), (19, "and " + items[4][1]), (11, p)]
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(found) == {(11, 1), (12, 1), (13, 1), (17, 2), (18, 3), (19, 5)} and found[11, 1] == 0


def test_short_items_are_found_between_word_borders(spark):
    items = [(1, "ab 12"), (2, "AB 12 "), (3, "é"), (4, " "), (5, "?!"), (6, "12 is the answer to all of it")]
    docs = [(1, "so ab\n12."), (2, "cab 12"), (3, "ab 123"), (4, "é"), (5, "éé"), (6, "what?!"), (7, ""), (8, None), (9, "12 is the answer to all of it, ab 12 (ab 12)")]
    found = {(r["doc_id"], r["item_id"], r["edits"]) for r in D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(1, 1, 0), (1, 2, 0), (4, 3, 0), (6, 5, 0), (9, 6, 0), (9, 1, 0), (9, 2, 0)}
    kept = {r["doc_id"] for r in D.clean_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {2, 3, 5, 7, 8}


def test_search_equals_quadratic_search():
    """Documents with edited stretches of items against every window of every item at every place."""
    import random

    rng = random.Random(21)
    items = [D.normal(words(k, n)) for k, n in ((60, 20), (61, 26), (62, 9))]
    block = D.Block(list(enumerate(items)))

    def edited(piece, edits):
        out = bytearray(piece)
        for _ in range(edits):
            place = rng.randrange(len(out))
            kind = rng.randrange(3)
            if kind == 0:
                out[place] = 35
            elif kind == 1:
                del out[place]
            else:
                out.insert(place, 35)
        return bytes(out)

    texts = []
    for k in range(36):
        item = items[k % 3]
        w, budget, _ = block.window(k % 3)
        at = rng.randrange(len(item) - w + 1)
        texts.append(D.normal(words(900 + k, 6)) + b" " + edited(item[at : at + w], rng.choice((0, budget - 1, budget, budget + 1, budget + 3))) + b" " + D.normal(words(950 + k, 6)))
    expected = set()
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            w, budget, _ = block.window(i)
            if any(edit_distance_inside(item[b : b + w], text) <= budget for b in range(len(item) - w + 1)):
                expected.add((t, i))
    assert {r[:2] for r in block.search(texts)} == expected
    assert 5 < len(expected) < len(texts)  # some are just beyond the budget


def edit_distance_inside(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_alignment_is_exact():
    import random

    rng = random.Random(1)
    for _ in range(150):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
        b = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 18)))
        edits, begin, end = D.align(a, b)
        assert edits == edit_distance_inside(a, b) and 0 <= begin <= end <= len(b)
        assert edit_distance_inside(a, b[begin:end]) == edits


def test_filter_never_loses_a_match():
    """Every stretch within the edit budget is found: random edits of a window, against the bound."""
    import random

    rng = random.Random(3)
    item = D.normal(words(77, 60))
    block = D.Block([(1, item)])
    w, k, _ = block.window(0)
    for _ in range(120):
        at = rng.randrange(len(item) - w)
        piece = bytearray(item[at : at + w])
        for _ in range(rng.randrange(k + 1)):
            place, kind = rng.randrange(len(piece)), rng.randrange(3)
            if kind == 0:
                piece[place] = 35
            elif kind == 1:
                del piece[place]
            else:
                piece.insert(place, 35)
        text = D.normal(words(rng.random(), 30)) + bytes(piece) + D.normal(words(rng.random(), 30))
        assert block.search([b"", text, b"short"]), (at, bytes(piece))


def test_stretches_find_what_the_whole_finds(monkeypatch):
    import random

    rng = random.Random(5)
    item = words(31, 60).encode()
    blanks = b"a" + b" " * 60 + b"b" + b" " * 30 + words(32, 12).encode()
    block = D.Block([(1, item), (2, blanks), (3, item[200:] + b" end")])
    texts = [b" " * 5000, words(33, 300).encode() + item[40:160] + b" " * 900 + blanks, b"", words(34, 80).encode() + item]
    texts.append(bytes(c if rng.random() > 0.01 else 46 for c in item[:200]))
    whole = {r[:2] for r in block.search(texts)}
    assert {(1, 0), (1, 1), (3, 0), (3, 2), (4, 0)} <= whole
    for pairs in (1, 50, 2000):
        monkeypatch.setattr(D, "PAIRS", pairs)
        assert {r[:2] for r in block.search(texts)} == whole


def test_decontamination_of_tables(spark, sf, odd, nothing):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [D.normal(r["text"]) for r in bench.collect()]
    expected = {r["doc_id"] for r in docs.collect() if any(i in D.normal(r["text"]) for i in items)}
    assert {r["doc_id"] for r in D.matches(docs, bench).collect()} == expected and expected
    assert {r["doc_id"] for r in D.clean_documents(docs, bench).collect()} == {r["doc_id"] for r in docs.collect()} - expected
    assert D.clean_documents(odd, bench).count() == odd.count() and D.clean_documents(odd, bench).columns == odd.columns
    assert D.matches(nothing, bench).count() == 0 and D.matches(docs, bench.limit(0)).count() == 0 and D.clean_documents(docs, bench.limit(0)).count() == docs.count()


def test_blocks_of_the_benchmark(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = Counter(map(tuple, D.matches(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    assert len(list(D._blocks(bench))) > 2
    assert Counter(map(tuple, D.matches(docs, bench).collect())) == whole


# ---- toxicity --------------------------------------------------------------


def brute_features(text):
    """Distinct hashed n-grams of the padded lower-case text, one by one."""
    points, out = [ord(c) for c in f" {text.lower()} "], set()
    for n in X.ORDERS:
        for k in range(len(points) - n + 1):
            h = points[k] + 1
            for x in points[k + 1 : k + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ x
            out.add(((h * 0x9E3779B1 + n) * 0x01000193 & 0xFFFFFFFF) >> 32 - X.HASH_BITS)
    return out


def test_presence_equals_brute_force():
    texts = ["", "ab", "Hello wOrld", "aaaaaaaa", "é ß 日本", "x" * 5000, "to be or not to be"]
    wanted = np.arange(1 << X.HASH_BITS) % 3 == 0
    for t, f, some in zip(texts, X.presence(texts), X.presence(texts, wanted), strict=True):
        assert sorted(brute_features(t)) == f.tolist() and some.tolist() == [x for x in f.tolist() if x % 3 == 0]


def test_model_equals_brute_force(spark):
    """Counts, selection, ratios and scores of a small table, recomputed from the n-grams."""
    from math import exp, log
    from zlib import crc32

    rows = [(k, words(700 + k, 12, 30) + (" vile scum" if k % 4 == 0 else "")) for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")
    model = X.train(docs, labels)
    fitted = [(k % 4 == 0, brute_features(t)) for k, t in rows if crc32(str(k).encode()) % 4 != 2]
    n1 = sum(y for y, _ in fitted)
    n0 = len(fitted) - n1
    c1, c0 = (Counter(x for y, f in fitted if y == toxic for x in f) for toxic in (True, False))
    chi = {x: (c1[x] * (n0 - c0[x]) - c0[x] * (n1 - c1[x])) ** 2 / ((c1[x] + c0[x]) * (n1 + n0 - c1[x] - c0[x] + 0.5)) for x in c1 | c0 if c1[x] + c0[x] >= 3}
    best = sorted((x for x in chi if chi[x] > 0), key=lambda x: (-chi[x], x))[: X.KEEP]
    kept = np.array(sorted(best))
    ratio = {x: log((c1[x] + 1) / (n1 + 2)) - log((c0[x] + 1) / (n0 + 2)) for x in best}
    assert np.allclose(X.log_count_ratios(np.array([c1[x] for x in best]), np.array([c0[x] for x in best]), n1, n0), list(ratio.values()))
    again = X.fit([np.array(sorted(f & set(best)), dtype=np.int64) for _, f in fitted], np.array([y for y, _ in fitted]), kept, n1 / (n1 + n0))
    assert set(np.flatnonzero(model.weights)) <= set(best) and np.allclose(model.weights, again.weights, atol=1e-4) and abs(model.intercept - again.intercept) < 1e-3
    # the weights are a stationary point of the penalised loss in units of the ratios
    columns = [np.searchsorted(kept, sorted(f & set(best))) for _, f in fitted]
    y = np.array([y for y, _ in fitted])
    w, b = X._regression(columns, y, len(kept), n1 / (n1 + n0), 1.0)
    r = np.array([ratio[x] for x in kept])
    p = np.array([1 / (1 + exp(-(w[c].sum() + b))) for c in columns])
    gradient = np.array([sum((p[i] - y[i]) * r[j] for i, c in enumerate(columns) if j in set(c.tolist())) + w[j] / r[j] for j in range(0, len(kept), 97)])
    assert np.abs(gradient).max() < 0.05 and abs((p - y).sum()) < 0.05
    found = {r_["doc_id"]: (r_["held_out"], r_["score"], r_["predicted"]) for r_ in X.score(docs, model).collect()}
    for k, t in rows:
        z = model.intercept + sum(float(model.weights[x]) for x in brute_features(t))
        held, score, predicted = found[k]
        assert abs(score - 1 / (1 + exp(-z))) < 1e-5 and held == (crc32(str(k).encode()) % 4 == 2) and predicted == int(score >= 0.3)
        assert predicted == int(k % 4 == 0)


def test_fair_cut():
    z, labels = np.array([-3, -2, -1, 0.0, 1, 2, 3]), np.array([0, 0, 0, 0, 1, 1, 1], bool)
    assert X.fair_cut(z, labels) == 0.5
    assert X.fair_cut(np.append(z, 1.5), np.append(labels, False)) == 1.75  # one clean row in five weighs more than one toxic row in three


def test_held_out_accuracy(spark):
    import os

    big = "/root/testdata/sf0.1"
    if not os.path.isdir(big):
        pytest.skip("test tables are not here")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = X.train(docs, labels)
    out = X.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").filter("held_out")
    n = out.count()
    right = out.filter("predicted = toxic").count()
    caught = out.filter("toxic = 1 AND predicted = 1").count() / out.filter("toxic = 1").count()
    false = out.filter("toxic = 0 AND predicted = 1").count() / out.filter("toxic = 0").count()
    assert right / n > 0.97 and caught >= 0.9 and false < 0.01


def test_scores_of_odd_documents(spark, odd, nothing, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = X.train(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    out = X.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (3, 4)}) == 1
    assert X.score(nothing, model).count() == 0
    blank = X.train(odd, labels.limit(0))
    assert {r["score"] for r in X.score(odd, blank).collect()} == {0.5}
    only = spark.createDataFrame([(k, 0) for k in range(40)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    assert {r["predicted"] for r in X.score(odd, X.train(odd, only)).collect()} == {0}


# ---- HTML ------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>one</p><p>two &amp; three</p>", "one\ntwo & three"),
        ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>a<b>b</b>  c\n d</p><p></p><div>e<br>f</div></article><footer>(c)</footer>", "T\nab c d\ne f"),
        ("<header>Site</header><main><p>Body text</p><aside>side</aside><form>q<input></form><p>More</p></main>", "Body text\nMore"),
        ("<script>var a='<p>x</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes", "yes"),
        ('<div class="cookie-notice">We use cookies</div><div><p>Text</p></div><div id="comments"><p>First!</p></div>', "Text"),
        ('<article><p>x</p><div class="ad">Buy</div><p>y</p><section class="comments"><p>c</p></section></article>', "x\ny"),
        ("<article><p>cut off in a ta", "cut off in a ta"),
        ("<article><p>cut</p><p cla", "cut"),
        ("<p>5 < 6 &lt; 7 &#233; &nope; &copy</p>", "5 < 6 < 7 é &nope; ©"),
        ("<nav>only menu</nav>", ""),
        ("<article><header><h1>Head</h1><span>by me</span></header><p>t</p></article>", "Head\nt"),
    ],
)
def test_pages(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div><p>A</p><aside>ad</aside><p>B is longer</p></div>", "A\nB is longer"),
        ("<body><section><h2>One</h2><p>first part</p></section><section><p>second</p></section><section><p>the third part</p></section></body>", "One\nfirst part\nsecond\nthe third part"),
        ("<header>Site</header><div><p>before</p><nav><a href=x>Home</a></nav><p>between</p><form>q</form><p>after</p></div><footer>(c)</footer>", "before\nbetween\nafter"),
        ("<section><p>outside</p></section><article><section><p>x</p></section><aside>ad</aside><section><p>y</p></section></article>", "x\ny"),
    ],
)
def test_pages_of_several_regions(page, text):
    assert H.main_text(page) == text


_LONG = "a long paragraph of running text " * 8


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div><section><p>first of two</p></section><section><p>the second</p></section></div>", "first of two\nthe second"),
        ("<p>before the box</p><aside>box</aside><p>behind it</p>", "before the box\nbehind it"),
        ("<body><form action=x><input><div><h1>T</h1><p>All of this page is in a form.</p><p>More.</p></div></form></body>", "T\nAll of this page is in a form.\nMore."),
        ('<article><div class="article-header"><h1>Title</h1><p>Lead.</p></div><p>Body.</p></article>', "Title\nLead.\nBody."),
        ('<article><p>Body.</p><div class="share-price-table"><p>1 2 3</p></div><div id="related-work"><p>Others did it.</p></div></article>', "Body.\n1 2 3\nOthers did it."),
        ("<div><p>Text.</p><p><a href=x>mostly a link here</a> x</p></div>", "Text.\nmostly a link here x"),
        ("<div><p><a href=x>mostly a link here</a> x</p></div>", "mostly a link here x"),
        ("<table><tr><td class=sidebar>Home</td><td><p>Cell text.</p></td></tr></table>", "Cell text."),
        ("<ul><li class=ad>Buy<li>kept</ul>", "kept"),
        (f'<article><h2>Teaser</h2></article><div class="x1"><p>{_LONG}</p></div><article><h2>Teaser</h2></article>', f"Teaser\n{_LONG.strip()}"),
    ],
)
def test_no_text_is_lost(page, text):
    assert H.main_text(page) == text


def unmarked_page(rng):
    """A page without telling tags or names, and its text: only lengths and links tell the article from what is around it."""
    name = lambda: f'class="{rng.choice("kqvx")}{rng.randrange(1000)}"'
    said = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n)) + "."
    links = lambda n: f"<ul {name()}>" + "".join(f'<li><a href="/{k}">{said(rng.randrange(1, 4))}</a></li>' for k in range(n)) + "</ul>"
    blocks = [said(rng.randrange(40, 160))] + [said(rng.choice((1, 3, 20, 60, 120))) for _ in range(rng.randrange(1, 12))] + [said(rng.randrange(30, 90))]
    body, title = name(), said(6)
    kind = rng.randrange(3)
    if kind == 0:  # paragraphs in one container
        inner = f"<div {body}><h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in blocks) + "</div>"
    elif kind == 1:  # every paragraph in a section of its own
        inner = f"<div><h1>{title}</h1></div>" + "".join(f"<div {body}><p>{x}</p></div>" for x in blocks)
    else:  # bare text, with an unrelated box of links in the middle of the markup
        inner = f"<div {body}><h2>{title}</h2>{blocks[0]}<p>" + "<p>".join(blocks[1:]) + "</div>"
    around = f"<div {name()}>{said(2)}</div><div {name()}>{links(rng.randrange(3, 9))}</div>"
    after = f"<div {name()}>{links(5)}</div><div {name()}>{said(4)}</div>"
    return f"<html><body {name()}>{around}<div {name()}>{inner}</div>{after}</body></html>", "\n".join([title, *blocks])


def test_surge_and_dive_find_unmarked_articles():
    import random

    rng = random.Random(12)
    for _ in range(300):
        page, text = unmarked_page(rng)
        assert H.main_text(page) == text, page


@pytest.mark.parametrize(
    "part",
    [
        '<section class="reader-comments"><p>I liked this article and the many things in it, thanks a lot.</p></section>',
        '<ol class="commentlist"><li>Great stuff, and many thanks for your work on this one.</li></ol>',
        '<div id="responses"><p>I disagree with nearly all of what was said above, honestly.</p></div>',
        '<div id="disqus_thread"><p>A comment and one more comment with several words in it.</p></div>',
        '<div class="advert-inline"><p>Buy now and save a lot of money on shoes and other goods.</p></div>',
        '<div class="ad-300x250"><p>Buy now and save a lot of money on shoes and other goods.</p></div>',
        '<div class="paywall-notice"><p>Subscribe to read the rest of this story and many more.</p></div>',
        '<div class="related-articles"><h3>Related</h3><a href=x>Another story</a></div>',
        "<script src=https://x.y/>var leak = 1;</script>",
        "<style/>p { color: red }</style>",
    ],
)
@pytest.mark.parametrize("outer", ["article", "div"])
def test_comments_adverts_and_notices_go(part, outer):
    text = ["The first paragraph of the article is long enough to count as text.", "Another one follows it, with many more words than a menu has."]
    body = "".join(f"<p>{t}</p>" for t in text)
    assert H.main_text(f"<html><body><{outer}>{body}{part}</{outer}></body></html>") == "\n".join(text)


def test_formulas_and_foreign_elements():
    page = "<article><p>Energy <math><mi>E</mi>=m</math> stays in <svg width=1/>the sentence, as it should.</p></article>"
    assert H.main_text(page) == "Energy E=m stays in the sentence, as it should."


def test_threshold_of_the_page():
    """A short block counts on a page of short blocks, and does not beside a long one."""
    short = "<div class=a>eleven char</div>"
    assert H.main_text(short + "<div class=b>another one here</div>") == "eleven char\nanother one here"
    assert H.main_text(short + f"<div class=b>{_LONG}</div>") == _LONG.strip()


def brute_article(page):
    import html

    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.DOTALL)[1]
    blocks = [html.unescape(re.sub(r"<[^>]*>?", " " if "<br" in b else "", b)) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def test_page_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    expected = {r["page_id"]: brute_article(r["html"]) for r in pages.collect()}
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.extract(pages).collect()}
    assert found == {k: (v, len(v)) for k, v in expected.items()}


def test_odd_pages(spark):
    rows = [(1, None, None, "c"), (None, "u", "", "c"), (2, "u", "<p>a", "c"), (2, "u", "<p>a", "c"), (3, "u", "<article>" + "<p>word " * 60_000, "c"), (4, "u", "<" * 50_000, "c"), (5, "u", '<a href="' * 5_000, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = H.extract(pages).collect()
    assert len(out) == 7 and [r["n_chars"] for r in out if r["page_id"] == 3] == [60_000 * 5 - 1]
    assert H.extract(pages.limit(0)).count() == 0


def test_regions():
    assert H.regions([0, 0, 5, 0, 0, 0, 7, 7, 0, 0, 0]) == [(2, 3), (6, 8)]
    assert H.regions([5, 0, 0, 5]) == [(0, 4)] and H.regions([0, 0]) == [] and H.regions([]) == []
