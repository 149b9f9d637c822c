"""Translations kept write by write, bounded calls, lists as a stream, the command of a provider."""

import json
import os
import random
import stat
import time

import pytest
from pyspark.sql import functions as F

from scriptloom.llm.common import shared_dir as llm_shared_dir
from scriptloom.model import Profile
from scriptloom.operators import runtime
from scriptloom.operators import translate as T
from scriptloom.shared import shared_dir
from scriptloom.sources import scripts
from scriptloom.sources import store as S
from scriptloom.sources.store import ProgressStore
from scriptloom.streaming import append


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, tr string, pos long")


def test_newest_wins_through_merges_and_crashes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FAN", 2)
    rng = random.Random(4)
    expected = {}
    for k in range(7):
        rows = [(f"t{i}", f"{k}-{i}", 100 * k + i) for i in rng.sample(range(12), 4)]
        store = ProgressStore(spark, str(tmp_path / "s"))
        if k == 4:  # a run that dies after it wrote a merged table, before the old ones go
            with monkeypatch.context() as m:
                m.setattr(store._fs.__class__, "delete", lambda *a: None, raising=False)
                store.append(table(spark, rows))
        else:
            store.append(table(spark, rows))
        for t, tr, pos in rows:
            expected[t] = (tr, expected.get(t, (0, pos))[1])
        got = {r["text"]: (r["tr"], r["pos"]) for r in ProgressStore(spark, str(tmp_path / "s")).read().collect()}
        assert got == expected
    assert len(store.live()) <= 4 and store.next_number() == 7
    # a write without its mark is not there, nor is one that a merged table covers
    path = str(tmp_path / "s" / "t0-50-50")
    table(spark, [("t1", "half", 0)]).withColumn("v", F.lit(50).cast("long")).write.parquet(path)
    os.remove(f"{path}/_SUCCESS")
    assert {r["text"]: (r["tr"], r["pos"]) for r in store.read().collect()} == expected
    store.append(table(spark, [("t1", "again", 5)]), 0)
    assert {r["text"]: (r["tr"], r["pos"]) for r in store.read().collect()} == expected


def test_a_repeated_write_counts_once(spark, tmp_path):
    store = ProgressStore(spark, f"file://{tmp_path}/s")
    assert store.read().count() == 0
    for tr in ("a", "b"):
        store.append(table(spark, [("x", tr, 1)]), 3)
    assert [tuple(r) for r in store.read().collect()] == [("x", "b", 1)]
    store.clear()
    assert store.next_number() == 0


def test_a_path_of_one_machine_is_refused_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

    assert S.shared_uri(Session(), "hdfs://a/b") == "hdfs://a/b"
    with pytest.raises(ValueError, match="share"):
        S.shared_uri(Session(), "/tmp/x")


def test_a_shared_folder_set_without_a_scheme_is_taken_on_a_cluster(spark, tmp_path, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

    get = type(spark.conf).get  # the setting itself is fixed once a session has begun
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: str(tmp_path) if key == "spark.checkpoint.dir" else get(self, key, *a))
    for shared in (shared_dir, llm_shared_dir):
        folder = shared(spark)
        assert S.shared_uri(Session(), folder) == folder and folder.startswith(f"file:{tmp_path}/")
        store = ProgressStore(spark, folder)
        store.append(table(spark, [("x", "a", 1)]))
        assert [tuple(r) for r in store.read().collect()] == [("x", "a", 1)]


@pytest.mark.parametrize("parallel", [1, 3])
def test_calls_in_flight_are_bounded(spark, tmp_path, parallel):
    """Calls note when they begin and end: never more than ``parallel`` at once, and no faster than one each pause."""
    notes, pause = str(tmp_path), 0.15

    @T.provider("counting")
    def _counting(api):
        def call(system, user):
            began = time.time()
            time.sleep(0.05)
            items = json.loads(user[user.index("[\n") :])
            with open(f"{notes}/{items[0]['id']}", "w") as f:
                f.write(f"{began} {time.time()}")
            return json.dumps([{"id": x["id"], "tr": x["text"]} for x in items])

        return call

    profile = Profile({"game_name": "G", "language_id": "el", "api": {"provider": "counting", "batch_size": 1}})
    rows = [(f"line {i}", "x", "f", i, "say", i) for i in range(12)]
    entries = spark.createDataFrame(rows, "text string, speaker string, file string, line int, kind string, seq long").repartition(8)
    make = T.PROVIDERS["counting"]
    try:
        call = make({})
        done = T.translate(entries, table(spark, []), profile, "s", pause, parallel=parallel, call=call).collect()
    finally:
        del T.PROVIDERS["counting"]
    assert {r["status"] for r in done} == {"ok"} and len(done) == 12
    spans = [tuple(map(float, (tmp_path / n).read_text().split())) for n in os.listdir(tmp_path)]
    assert len(spans) == 12
    assert max(sum(a <= t < b for a, b in spans) for t, _ in spans) <= parallel
    length = max(b for _, b in spans) - min(a for a, _ in spans)
    assert length >= pause * (12 - parallel) * 0.6  # tasks may hold uneven shares; each keeps its own pause


def test_lists_as_a_stream_equal_one_batch(spark, tmp_path):
    """Any cut of the snapshots into micro-batches gives the same members, each translated once."""
    rng = random.Random(8)
    lists = {f"l{k}": [f"t{rng.randrange(15)}" for _ in range(rng.randrange(9))] for k in range(6)}
    known = table(spark, [(f"t{k}", f"T{k}", k) for k in range(0, 15, 2)])
    ProgressStore(spark, str(tmp_path / "store")).append(known)
    source, schema = tmp_path / "in", "name string, items array<string>"
    for cut in range(3):
        rows = [(n, items[: len(items) * (cut + 1) // 3] or None) for n, items in lists.items()]
        if cut == 1:
            rows += [("l0", lists["l0"][:1]), ("l1", [])]  # an older and an empty snapshot
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source))
        append.append_stream(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("name", "pos", "shown").collect())
    whole = spark.createDataFrame([(n, items, 0) for n, items in lists.items()], schema + ", before int")
    shown = runtime.translate_arrays(whole, known, "items", since="before")
    assert got == sorted((r["name"], k, x) for r in shown.collect() for k, x in enumerate(r["items"]))
    # a later translation refreshes nothing that was shown
    ProgressStore(spark, str(tmp_path / "store")).append(table(spark, [("t1", "late", 99)]))
    spark.createDataFrame([("l0", [*lists["l0"], "t1"])], schema).write.mode("append").json(str(source))
    append.append_stream(spark.readStream.schema(schema).json(str(source)), str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    again = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("name", "pos", "shown").collect())
    assert again == sorted([*got, ("l0", len(lists["l0"]), "late")])


def test_command_of_a_provider(tmp_path, monkeypatch):
    """A stub on PATH: options it describes are passed, the prompt comes by its input, failures and time limits are told."""
    stub = tmp_path / "claude"
    stub.write_text('#!/bin/sh\ncase "$*" in *--help*) echo "--max-turns N";; *--model\\ slow*) sleep 5;; *--model\\ bad*) echo why >&2; exit 3;; *) echo "$*"; cat; pwd;; esac\n')
    stub.chmod(stub.stat().st_mode | stat.S_IEXEC)
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    said = T.CommandLine({"model": "m"})("sys", "user").split("\n")
    assert said[0] == "-p --model m --max-turns 1" and said[1:4] == ["sys", "", "user" + os.path.sep + said[3].split("user/", 1)[1]]
    with pytest.raises(T.ProviderError, match="status 3: why"):
        T.CommandLine({"model": "bad"})("s", "u")
    with pytest.raises(T.ProviderError, match="0.2 seconds"):
        T.CommandLine({"model": "slow", "timeout": 0.2})("s", "u")
    monkeypatch.setenv("PATH", "")
    with pytest.raises(T.ProviderError, match="not installed"):
        T.CommandLine({})


@pytest.mark.parametrize(
    "noise",
    ["\x1b[38;2;1;2;3m", "\x1b[?25l", "\x1b[>4;1m", "\x1b[=1u", "\x9b1m", "\x1bP1$r0m\x1b\\", "\x1b]8;;http://x\x1b\\", "\x9d0;t\x9c", "\x1b_x\x1b\\", "\x1b^y\x07", "\x1b(B", "\x1b7", "\x1b=", "\x1bM"],
)
def test_terminal_codes_go(noise):
    assert T.reply_array(f'{noise}[{noise}{{"id": 1, "tr": "a"}}]{noise}') == [{"id": 1, "tr": "a"}]


@pytest.mark.parametrize("raw", ['```\n[1]\n```', '```json  \n[1]\n```  \n', "```json\n[1]", '```json\n[1]```', "``` py x\n\n[1]\n\n```"])
def test_fences_go(raw):
    assert T.reply_array(raw) == [1]


def test_parquet_in_and_out(spark, tmp_path):
    rows = [("a", "s", "f", 1, "say", 0), ("b", "s", "f", 2, "say", 1)]
    entries = spark.createDataFrame(rows, "text string, speaker string, file string, line int, kind string, seq long")
    scripts.save_entries(entries, str(tmp_path / "e"))
    assert sorted(tuple(r) for r in scripts.load_entries(spark, str(tmp_path / "e")).collect()) == rows
    path = str(tmp_path / "p")
    assert scripts.load_progress(spark, path).count() == 0
    assert scripts.save_progress(table(spark, [("a", "x", 1)]), path) == 1
    more = T.upserted(scripts.load_progress(spark, path), table(spark, [("a", "y", 9), ("b", "z", 3)]))
    assert scripts.save_progress(more, path) == 2
    assert sorted(tuple(r) for r in scripts.load_progress(spark, path).collect()) == [("a", "y", 1), ("b", "z", 3)]
