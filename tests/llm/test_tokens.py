"""Token counts, id shards, packing, chat formatting."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptloom.llm import chat as C
from scriptloom.llm import encode as E
from scriptloom.llm import packing as P
from scriptloom.llm import tokenids as I
from scriptloom.llm import tokens as T
from scriptloom.llm.elias_fano import EliasFano

from .conftest import odd_texts

BYTE, WORD = T.vocabulary("byte_bpe_50k.json"), T.vocabulary("word_bpe_49k.json")
ALPHABET = st.sampled_from(list(" \n\t\r\x0b\x1c\x85 '.,!?#0189abcXYZéßÉİſςΣ日本́ ") + ["  ", "<|endoftext|>", "'s", "hello", "World"])
TEXTS = st.lists(ALPHABET, max_size=40).map("".join)


def ids(path, text):
    return T.tokenizer(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_encoder_equals_the_library(texts):
    for path in (BYTE, WORD):
        e = E.encoder(path)
        assert [np.frombuffer(x, f"<u{e.width}").tolist() for x in e.encode(texts)] == [ids(path, t) for t in texts]


def test_rank_merging_is_proven():
    assert E.encoder(BYTE).ranks is not None and E.encoder(WORD).ranks is not None


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(4, 30), st.integers(1, 9))
def test_chunked_count(text, chunk, overlap):
    t = T.tokenizer(BYTE)
    assert T.count_long(T._starts(t), text, chunk, overlap) == len(ids(BYTE, text))


def test_counts_of_documents(spark, odd, nothing, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    found = Counter(map(tuple, T.token_counts(docs, BYTE, chunk=5_000, overlap=16).collect()))
    expected = Counter()
    for r in docs.collect():
        n = len(ids(BYTE, r["text"] or ""))
        expected[r["doc_id"], len((r["text"] or "").encode()), n, n > 512] += 1
    assert found == expected and T.token_counts(nothing, BYTE).count() == 0


def test_sentencepiece_counts(spark):
    docs = spark.createDataFrame([(1, "Hello  world"), (2, None)], "doc_id long, text string")
    path = T.vocabulary("piece_bpe_32k.model")
    found = {r["doc_id"]: r["n_tokens"] for r in T.token_counts(docs, path).collect()}
    assert found == {1: len(T.tokenizer(path).encode("Hello  world")), 2: 0}


# ---- Elias-Fano and shards -------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700).map(sorted))
def test_elias_fano(values):
    f = EliasFano.from_bytes(EliasFano.build(np.array(values, np.uint64)).to_bytes())
    assert f.slice(0, len(values)).tolist() == values
    for k in range(0, len(values), 97):
        assert f.select(k) == values[k]
    with pytest.raises(IndexError):
        f.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000)).astype(np.uint64)
    assert len(EliasFano.build(ends).to_bytes()) * 8 / len(ends) < 2 + np.log2(1000) + 1.2


def expected_ids(rows, path, end):
    ordered = sorted(((d, [*ids(path, t or ""), end]) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    out, at = Counter(), 0
    for d, x in ordered:
        out[d, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
        at += len(x)
    return out


def test_token_ids(spark, odd, nothing, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    found = Counter(map(tuple, I.token_ids(docs, WORD, 2).collect()))
    assert found == expected_ids([tuple(r) for r in docs.collect()], WORD, 2)
    assert I.token_ids(nothing, WORD, 2).count() == 0


def test_shard_random_access(tmp_path):
    folder = f"file://{tmp_path}"
    w = I.ShardWriter(folder, 3, 2)
    data = [(None, [1]), (-7, [2, 3]), (-7, []), (12, list(range(500)))]
    for d, x in data:
        w.add(d, np.array(x, "<u2").tobytes())
    s = w.close()
    r = I.ShardReader(folder, s.path)
    assert (s.n_docs, s.n_ids) == (4, 503) and r.doc_ids(0, 4) == [None, -7, -7, 12] and r.doc_ids(1, 3) == [-7, -7]
    assert [r.document(k).tolist() for k in range(4)] == [x for _, x in data]


# ---- packing ---------------------------------------------------------------


def check_pack(rows, pieces, length):
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    total = sum(p["length"] for p in pieces)
    for k, found in by.items():
        at = 0
        for offset, n in sorted(found):
            assert offset == at and n > 0
            at += n
        assert at == length or (at < length and at & (at - 1) == 0), (k, at)
    assert sum(1 for v in by.values() if sum(n for _, n in v) < length) <= length.bit_length()
    docs = Counter()
    for d, t in rows:
        docs[d, len(ids(BYTE, t or "")) + 1] += 1
    seen = Counter()
    for p in pieces:
        if p["start"] == 0:
            seen[p["doc_id"], p["doc_tokens"]] += 1
    assert seen == docs and total == sum(n * c for (_, n), c in docs.items())


@pytest.mark.parametrize("length", [1024, 64])
def test_packing(spark, odd, nothing, sf, length):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    pieces = P.pack(docs, BYTE, 0, length).collect()
    check_pack(rows, pieces, length)
    unique = {d: t for d, t in rows if d is not None and d >= 20}
    for p in pieces:
        if p["doc_id"] in unique:
            x = np.array([*ids(BYTE, unique[p["doc_id"]]), 0], "<u4")[p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(x.tobytes()) and len(x) == p["length"]
    assert P.pack(nothing, BYTE, 0, length).count() == 0


def test_hilbert_curve_is_a_path():
    grid = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(P.hilbert(grid, bits=2))
    assert sorted(P.hilbert(grid, bits=2).tolist()) == list(range(64))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_sequences_follow_the_curve(spark, sf):
    """In the order of the packed stream, the Hilbert keys of the documents ascend, cell by cell; split cells are full ones."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = T.vocabulary("byte_bpe_50k.json")
    keys = {r["doc_id"]: r["key"] for r in P._encode(docs, path, 0).select("doc_id", "key").collect()}
    pieces = sorted((r["sequence_id"], r["offset"], r["doc_id"]) for r in P.pack(docs, path).filter("start = 0").collect())
    cells = [keys[d] >> (P.DIMS * P.BITS + P.TIE_BITS - P.CELL_BITS) for _, _, d in pieces]
    assert len(cells) == len(keys) and cells == sorted(cells)
    order = [keys[d] for _, _, d in pieces]
    alone = [c for c in set(cells) if cells.count(c) > 1]
    assert sum(a > b for a, b in zip(order, order[1:])) <= len(alone) * 4  # only where a hot cell was split by the hash


def test_only_known_files_are_merged_by_rank():
    import json

    for name, words_ in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        with open(T.vocabulary(name), encoding="utf-8") as f:
            plain = json.load(f)
        assert E._plain(plain, words_)
        byte_level = plain["pre_tokenizer"].get("pretokenizers", [plain["pre_tokenizer"]])[-1]
        assert not E._plain(plain | {"pre_tokenizer": byte_level | {"add_prefix_space": True}}, words_)
        assert not E._plain(plain | {"normalizer": {"type": "NFKC"}}, words_)
        assert not E._plain(plain | {"added_tokens": [plain["added_tokens"][0] | {"lstrip": True}]}, words_)
        assert not E._plain(plain | {"pre_tokenizer": {"type": "Whitespace"}}, words_)


def test_neighbours_are_alike():
    a, b = [np.frombuffer(E.encoder(BYTE).encode([t])[0], "<u2") for t in ("the cat sat on the mat " * 30, "the cat sat on the mat " * 29 + "a dog")]
    assert np.abs(P.points([a])[0].astype(int) - P.points([b])[0].astype(int)).max() <= 12


def test_hot_cells_are_split():
    plan = P._plan([(1, 10), (2, 1000), (3, 5), (9, 5)], 10)
    assert plan == [(1, 0, 1), (2, 1, 10), (3, 11, 1), (9, 11, 1)]


# ---- chat ------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*C.CONTROL, "\\", "<", "s>", "|", "]", "[", "/", "a", "\n"]), max_size=12).map("".join))
def test_escape(text):
    e = C.escape(text)
    assert C.unescape(e) == text and not any(c in e for c in C.CONTROL)


ROLES = st.sampled_from(["user", "assistant", "system", "", "<|says|>", "odd\nrole\\"])
SAID = st.lists(st.sampled_from([*C.CONTROL, "\\", "x", "\n", "é"]), max_size=6).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(ROLES, SAID), max_size=6))
def test_read_back(turns):
    reader = C.Reader()
    for piece, loss in C.compile_template()(C.Turn(*t) for t in turns):
        reader.feed(piece, loss)
    said = "".join(t for r, t in turns if r == "assistant")
    text, spans = C.render([C.Turn(*t) for t in turns])
    expected = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert reader.digest() == (len(turns), expected, len(said), hashlib.sha256(said.encode()).hexdigest(), len(text))
    assert "".join(C.unescape(text[a:b]) for a, b in spans) == said


def test_template_language():
    source = "{# c #}{% for m in turns %}{% if loop.first %}^{% endif %}{% if m.role == 'a' and not loop.last %}A{% elif 'x' + 'y' == 'xy' %}[{{ m.text | trim | upper }}{{ loop.index + 1 }}]{% else %}never{% endif %}{% endfor %}$"
    assert C.render([C.Turn("a", "1"), C.Turn("b", " q "), C.Turn("a", "z")], source)[0] == "^A[Q3][Z4]$"
    folded = C.fold(C.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}no{% else %}d{% endif %}"))
    assert folded == (C.Text("abcd"),)


@pytest.mark.parametrize(
    "source",
    ["{{ m.text }}", "{% for m in turns %}{{ m.__class__ }}{% endfor %}", "{{ open('x') }}", "{% for m in turns %}", "{% endif %}", "{{ 'a' | eval }}", "{% import os %}", "{{ 'a' ", "{% for m in turns %}{% for n in turns %}{% endfor %}{% endfor %}", "{{ 1 + }}", "{% for m in turns %}{{ m['text'] }}{% endfor %}"],
)
def test_sandbox(source):
    with pytest.raises(C.TemplateError):
        C.compile_template(source)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo</s>"), (1, 1, "assistant", "yo</s>"), (2, None, None, None), (None, 5, "user", "x"), (3, 2, "assistant", None), (3, 1, "user", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    found = {r["conv_id"]: r for r in C.digests(df).collect()}
    assert set(found) == {1, 2, 3, None} and found[1]["n_turns"] == 3 and found[1]["loss_chars"] == 12
    assert found[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    text = {}
    for r in C.format_turns(df).orderBy("conv_id", "piece_no").collect():
        text[r["conv_id"]] = text.get(r["conv_id"], "") + r["piece"]
    assert {k: len(v) for k, v in text.items()} == {k: r["formatted_chars"] for k, r in found.items()}
    assert C.digests(df.limit(0)).count() == 0
    # cut into many chunks, what is read back is the same; the mask comes from the written spans alone
    whole = C.format_chunks(df, size=3)
    again = {r["conv_id"]: r for r in C.read_formatted(whole).collect()}
    assert again == found and whole.count() > 10
    for r in whole.collect():
        said = [r["text"][x["a"] : x["b"]] for x in r["loss"]]
        assert all(x and x in ("yo" + C.escape("</s>"), "") for x in said)
    lost = whole.filter("NOT (conv_id = 1 AND begin = 0)")
    with pytest.raises(Exception, match="is missing"):
        C.read_formatted(lost).collect()


def test_queries_against_sql(spark, sf):
    import duckdb

    from scriptloom.llm.queries import ORACLES, QUERIES

    db = duckdb.connect()
    for name in ("documents", "conversations", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    # a column of numbers with nulls is one of floats on one side only
    plain = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v.is_integer() else v
    for name, sql in ORACLES.items():
        frame, oracle = QUERIES[name](spark, sf).toPandas(), db.execute(sql).df()
        columns = sorted(frame.columns)
        assert columns == sorted(oracle.columns)
        left, right = (sorted((tuple(map(plain, r)) for r in f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)), key=repr) for f in (frame, oracle))
        assert left == right, name


def test_odd_texts_are_what_they_say():
    assert any(t is None for _, t in odd_texts()) and F is not None
