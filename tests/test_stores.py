"""Arrival order, buffered shuffles, samplers, stored tables, indexed lines, manifests and token binaries against plain Python."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.operators import buffered, quota
from lexmill.operators.sampler import Sampler, sampled
from lexmill.plans import validation
from lexmill.sources import commit, files, indexed
from lexmill.sources.arrival import arrived
from lexmill.streaming import logs as arriving_logs


# ---- arrival ----
def test_arrival_is_the_order_of_files_and_rows(spark, tmp_path):
    rows = [(f"t{i}", "clash") for i in range(57)]
    for k, part in enumerate((rows[:20], rows[20:20], rows[20:50], rows[50:])):
        spark.createDataFrame(part, "text string, arrival string").coalesce(1).write.parquet(str(tmp_path / f"f{k}"))
    import shutil

    (tmp_path / "all").mkdir()
    for k in range(4):
        for f in (tmp_path / f"f{k}").glob("part-*.parquet"):
            shutil.copy(f, tmp_path / "all" / f"{k}.parquet")
    got = arrived(spark, str(tmp_path / "all")).collect()
    assert {r.arrival: r.text for r in got} == {i: t for i, (t, _) in enumerate(rows)}


def test_quotas_follow_arrival_without_ids(spark, tmp_path):
    draw = random.Random(4)
    rows = [(draw.choice("ab"), draw.randrange(1, 9)) for _ in range(300)]
    spark.createDataFrame(rows[:100], "source string, n long").coalesce(1).write.parquet(str(tmp_path / "x"))
    spark.createDataFrame(rows[100:], "source string, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "x"))
    d = arrived(spark, str(tmp_path / "x")).cache()
    order = [(r.source, r.n) for r in d.orderBy("arrival").collect()]
    assert Counter(order) == Counter(rows)
    table = quota.quota_table(spark, quota.quotas([("a", 0.5), ("b", 0.5)], 400))
    got = quota.exact_cut(quota.running(quota.with_quota(d, table), "n", "arrival", "source")).collect()
    left, want = {"a": 200, "b": 200}, {}
    for i, (s, n) in enumerate(order):
        if left[s]:
            want[i] = min(n, left[s])
            left[s] -= want[i]
    assert {r.arrival: r.taken for r in got} == want


def test_running_sums_count_each_row_of_a_tie(spark, monkeypatch):
    """Rows that share an order key have sums of their own, so cuts are exact all the same."""
    rows = [("a", i // 4, 3) for i in range(100)]
    for each in (1000, 7):
        monkeypatch.setattr(quota, "RANGE_ROWS", each)
        got = [r.through for r in quota.running(spark.createDataFrame(rows, "source string, k long, n long"), "n", "k", "source").collect()]
        assert sorted(got) == [3 * (i + 1) for i in range(100)]


# ---- buffered shuffle ----
def plain_buffered(n, size, seed):
    """Rows by place, with a buffer."""
    draw = lambda t: int(hashlib.md5(f"{seed}:{t}".encode()).hexdigest()[:8], 16) % size
    buffer, out = [], []
    for t in range(n):
        if len(buffer) < size:
            buffer.append(t)
        else:
            s = draw(t)
            out.append(buffer[s])
            buffer[s] = t
    last = sorted(range(len(buffer)), key=lambda s: (hashlib.md5(f"{seed}:end:{s}".encode()).hexdigest(), s))
    return out + [buffer[s] for s in last]


@pytest.mark.parametrize("n,size", [(0, 5), (1, 1), (3, 5), (5, 5), (6, 5), (200, 1), (200, 7), (300, 299), (50, 1000)])
def test_buffered_order_is_that_of_a_buffer(spark, monkeypatch, n, size):
    df = spark.range(n).select(F.col("id").alias("arrival"), F.col("id").alias("place"))  # a column of the result's name is replaced
    for each in (1 << 22, 16):
        monkeypatch.setattr(buffered, "RANGE", each)
        got = {r.place: r.arrival for r in buffered.buffered(df, size, 11).collect()}
        order = [got[i] for i in range(n)]
        assert order == plain_buffered(n, size, 11) and all(p > i - size for p, i in enumerate(order))


def test_a_buffer_holds_a_row(spark):
    with pytest.raises(ValueError, match="one row"):
        buffered.buffered(spark.range(3).withColumnRenamed("id", "arrival"), 0, 1)


# ---- sampler ----
def turns(df):
    return [(r.epoch, r.place, r.item) for r in sorted(df.collect(), key=lambda r: r.turn)]


def test_a_resumed_sampler_goes_on_exactly(spark):
    whole, first = Sampler(29, 123), Sampler(29, 123)
    want, a = turns(whole.take(spark, 16)), turns(first.take(spark, 7))
    resumed = Sampler(29, 123)
    assert resumed.load(first.state()) and resumed.left() == 22
    b = turns(resumed.take(spark, 9))
    assert a + b == want and len({i for _, _, i in want}) == 16


@given(st.integers(1, 40), st.integers(0, 99), st.lists(st.integers(0, 50), min_size=1, max_size=4))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_stops_do_not_change_what_is_sampled(spark, size, seed, steps):
    whole, now, got = Sampler(size, seed), Sampler(size, seed), []
    for n in steps:
        got += turns(now.take(spark, n))
        after = Sampler(size, seed)
        after.load(json.loads(json.dumps(now.state())))
        now = after
    want = turns(whole.take(spark, sum(steps)))
    assert got == want and whole.state() == now.state()
    for e in {e for e, _, _ in want}:
        items = [i for x, _, i in want if x == e]
        assert len(set(items)) == len(items) and all(0 <= i < size for i in items)


def test_changed_data_resets_the_sampler_alone(spark):
    old = Sampler(29, 123, "a")
    old.take(spark, 40)
    assert (old.epoch, old.offset) == (1, 11)
    new = Sampler(31, 9, "b")
    assert not new.load(old.state()) and new.state() == Sampler(31, 9, "b").state()
    with pytest.raises(ValueError, match="seed"):
        Sampler(29, 5, "a").load(old.state())
    with pytest.raises(ValueError, match="outside"):
        Sampler(29, 123, "a").load({**old.state(), "offset": 30})
    assert not Sampler(3, 1).load({}) and not Sampler(3, 1).load(None)
    with pytest.raises(ValueError, match="nothing"):
        Sampler(0, 1).take(spark, 1)
    rows = spark.range(29).select(F.col("id").alias("row"), F.lit("x").alias("text"))
    drawn = sampled(rows, Sampler(29, 123, "a"), 58, "row").collect()
    assert Counter(r.row for r in drawn) == Counter({i: 2 for i in range(29)}) and {r.turn for r in drawn} == set(range(58))


# ---- stored tables ----
def test_a_killed_write_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    old, new = spark.range(10), spark.range(20)
    assert commit.write(old, path, "one") and not commit.write(new, path, "one") and commit.read(spark, path).count() == 10
    boom = new.select(F.when(F.col("id") < 19, F.col("id")).otherwise(F.raise_error(F.lit("killed")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        commit.write(boom, path, "two")  # dies while it writes
    assert commit.read(spark, path).count() == 10
    with monkeypatch.context() as m:
        m.setattr(commit, "put_json", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            commit.write(new, path, "two")  # dies when all rows are written, before the commit
    assert commit.read(spark, path).count() == 10 and commit.current(spark, path)["fingerprint"] == "one"
    assert commit.write(new, path, "two") and commit.read(spark, path).count() == 20
    gone = commit.clean(spark, path)
    assert gone and commit.read(spark, path).count() == 20 and not commit.clean(spark, path)
    with pytest.raises(FileNotFoundError):
        commit.read(spark, f"file://{tmp_path}/none")


def test_small_files_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.json"
    commit.put_json(spark, path, {"a": "ä\n"})
    commit.put_json(spark, path, [1, None])
    assert commit.get_json(spark, path) == [1, None] and json.loads((tmp_path / "a/b.json").read_text()) == [1, None]
    assert [f.name for f in (tmp_path / "a").iterdir() if not f.name.endswith(".crc")] == ["b.json"]


def test_upsert_rewrites_only_what_it_meets(spark, tmp_path):
    path = f"{tmp_path}/t x"
    df = spark.createDataFrame([(i, i % 3, f"v{i}") for i in range(40)] + [(None, 0, "null")], "k long, j long, v string")
    commit.write(df.repartitionByRange(5, "k").sortWithinPartitions("k"), path)
    before = commit.current(spark, path)["files"]
    said = commit.upsert(spark.createDataFrame([(1, 1, "new"), (2, 2, None), (99, 0, "added"), (3, 7, "other key"), (None, 0, "known")], "k long, j long, v string"), path, ["k", "j"])
    after = commit.current(spark, path)["files"]
    assert said["rewritten"] + said["kept"] == len(before) and said["kept"] >= 3 and len(set(before) & set(after)) == said["kept"]
    want = {(i, i % 3): f"v{i}" for i in range(40)} | {(1, 1): "new", (2, 2): None, (99, 0): "added", (3, 7): "other key", (None, 0): "known"}
    assert {(r.k, r.j): r.v for r in commit.read(spark, path).collect()} == want and commit.read(spark, path).count() == len(want)
    assert commit.upsert(spark.createDataFrame([(500, 1, "x")], "k long, j long, v string"), path, ["k", "j"])["rewritten"] == 0
    assert commit.upsert(df, f"{tmp_path}/new", ["k"]) == {"rewritten": 0, "kept": 0} and commit.read(spark, f"{tmp_path}/new").count() == 41
    commit.write(df.where("false"), f"{tmp_path}/empty")
    commit.upsert(df, f"{tmp_path}/empty", ["k", "j"])
    assert commit.read(spark, f"{tmp_path}/empty").count() == 41


# ---- indexed lines ----
@pytest.mark.parametrize("split", [3, 64, 1 << 20])
def test_lines_are_found_by_their_place(spark, tmp_path, split):
    texts = [b"", b"one", b"one\n", b"\n\n a \r\nlast", "ä€\n😀".encode() + b"\n" + b"x" * 500 + b"\n", b"\n"]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.jsonl").write_bytes(t)
    paths = [str(tmp_path / f"{i}.jsonl") for i in range(len(texts))]
    listed, index = indexed.build(spark, paths, str(tmp_path / "index"), split)
    want, at = {}, {}
    for i, t in enumerate(texts):
        o = 0
        for k, line in enumerate(t.splitlines(keepends=True) if b"\r" not in t else [b"\n", b"\n", b" a \r\n", b"last"]):
            want[i, k], at[i, k] = line, (o, len(line))
            o += len(line)
    assert {(r.file, r.line): (r.offset, r.length) for r in index.collect()} == at
    places = spark.createDataFrame([(*p, "kept") for p in want] + [(1, 9, "outside"), (9, 0, "outside")], "file int, line long, about string").repartition(3)
    got = indexed.lines_at(places, listed, index).collect()
    assert {(r.file, r.line): (r.value, r.bytes_read, r.about) for r in got} == {p: (x.removesuffix(b"\n").removesuffix(b"\r").decode(), len(x), "kept") for p, x in want.items()}
    assert indexed.lines_at(places.where("false"), listed, index).count() == 0


def test_only_the_wanted_bytes_are_read(spark, tmp_path, monkeypatch):
    """The same three lines of a file a thousand times as long: as many bytes, and the index is made once for each state of the files."""
    lines = [json.dumps({"i": i, "t": "x" * (i % 50)}) for i in range(20_000)]
    read = []
    for n in (20, 20_000):
        path = tmp_path / f"{n}.jsonl"
        path.write_text("\n".join(lines[:n]) + "\n")
        listed, index = indexed.build(spark, [str(path)], str(tmp_path / f"index{n}"))
        places = spark.createDataFrame([(0, k) for k in (0, 7, 19)], "file int, line long")
        got = indexed.lines_at(places, listed, index).collect()
        assert {r.line: r.value for r in got} == {k: lines[k] for k in (0, 7, 19)}
        read.append(sum(r.bytes_read for r in got))
    assert read[0] == read[1] == sum(len(lines[k]) + 1 for k in (0, 7, 19))
    first = commit.current(spark, str(tmp_path / "index20"))["generation"]
    indexed.build(spark, [str(tmp_path / "20.jsonl")], str(tmp_path / "index20"))
    assert commit.current(spark, str(tmp_path / "index20"))["generation"] == first
    (tmp_path / "20.jsonl").write_text("changed\n")
    listed, index = indexed.build(spark, [str(tmp_path / "20.jsonl")], str(tmp_path / "index20"))
    assert commit.current(spark, str(tmp_path / "index20"))["generation"] != first and index.count() == 1


# ---- manifests ----
def test_manifests_name_what_is_wrong(spark, tmp_path):
    folder = tmp_path / "data"
    (folder / "below").mkdir(parents=True)
    names = [f"f{i}.bin" for i in range(300)] + ["below/g.bin", "empty.bin", "ü x.bin"]
    for n in names:
        (folder / n).write_bytes(b"" if n == "empty.bin" else n.encode() * 100)
    recorded = validation.file_digests(validation.files_of(spark, str(folder))).cache()
    assert {r.name: (r.bytes, r.sha256) for r in recorded.collect()} == {n: ((folder / n).stat().st_size, hashlib.sha256((folder / n).read_bytes()).hexdigest()) for n in names}
    assert validation.manifest_errors(recorded, spark, str(folder)).count() == 0
    (folder / "f0.bin").unlink()
    (folder / "f1.bin").write_bytes(b"short")
    (folder / "below/g.bin").write_bytes(b"x" * len("below/g.bin" * 100))
    (folder / "more.bin").write_bytes(b"more")
    got = {r.name: r.error for r in validation.manifest_errors(recorded, spark, str(folder)).collect()}
    assert got == {"f0.bin": "missing", "f1.bin": "5 bytes, not 600", "below/g.bin": "other content", "more.bin": "not in the manifest"}


# ---- token binaries ----
def test_damaged_parts_are_named(spark, tmp_path):
    stream = spark.range(50).select((F.col("id") * 10).alias("start"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col("id") * 10 + i).cast("int") % 128).alias("ids"))
    folder = str(tmp_path / "t")
    files.write_token_binary(stream, folder, 500, [], "t", items=100)
    parts = validation.part_table(spark, 500, 100)
    scan = lambda vocabulary=128, chunk=16: validation.scan_parts(spark, folder, vocabulary, chunk=chunk)
    ids = np.arange(500) % 128
    want = {f"tokens-{k:06d}.bin": (200, 100, p.min(), p.max(), 0, p.sum()) for k, p in enumerate(ids.reshape(5, 100))}
    for chunk in (2, 64, 1 << 20):
        assert {r.name: tuple(r)[1:] for r in scan(chunk=chunk).collect()} == want
    assert validation.token_part_errors(scan(), parts).count() == 0
    validation.require(validation.token_part_errors(scan(), parts))
    at = tmp_path / "t"
    (at / "tokens-000000.bin").unlink()
    (at / "tokens-000001.bin").write_bytes((at / "tokens-000001.bin").read_bytes()[:-1])
    raw = np.fromfile(at / "tokens-000002.bin", "<u2")
    raw[[3, 50]] = 40_000, 128
    raw.tofile(at / "tokens-000002.bin")
    (at / "tokens-000003.bin").write_bytes(b"")
    (at / "extra.bin").write_bytes(b"\0\0")
    got = sorted((r.name, r.error) for r in validation.token_part_errors(scan(), parts).collect())
    assert got == sorted([
        ("tokens-000000.bin", "missing"), ("tokens-000001.bin", "99 tokens, not 100"), ("tokens-000001.bin", "199 bytes for 99 tokens"),
        ("tokens-000002.bin", "2 ids outside the vocabulary, up to 40000"), ("tokens-000003.bin", "0 tokens, not 100"), ("extra.bin", "not a part of the stream"),
    ])
    with pytest.raises(ValueError, match="tokens-000000.bin: missing"):
        validation.require(validation.token_part_errors(scan(), parts))
    with pytest.raises(ValueError, match="whole items"):
        scan(chunk=3)


def test_states_of_token_binaries(spark):
    sources = spark.createDataFrame([("a", 60, 60), ("b", 40, 39), ("c", 5, None)], "source string, quota long, tokens long")
    state = {"tokens": 100, "target_tokens": 105, "vocab_size": 128, "tokenizer_sha256": "x"}
    got = {(r.name, r.error) for r in validation.state_errors(state, sources, 105, 128, "y").collect()}
    assert got == {("state", "100 tokens, not 105"), ("state", "x tokenizer_sha256, not y"), ("sources", "99 tokens, not 105"), ("b", "39 tokens, not 40"), ("c", "no tokens, not 5")}
    right = spark.createDataFrame([("a", 100, 100)], "source string, quota long, tokens long")
    assert validation.state_errors({**state, "target_tokens": 100}, right, 100, 128, "x").count() == 0


def test_training_is_checked_before_it_starts(spark, tmp_path):
    good = {"training": {"batch_size": 8, "gradient_accumulation_steps": 1, "learning_rate": 1e-4, "max_steps": 10, "save_steps": 5, "grad_clip": 1.0, "warmup_steps": 0, "dtype": "bfloat16"}}
    assert validation.training_errors(good) == []
    wrong = validation.training_errors({"training": {**good["training"], "max_steps": 0, "learning_rate": "fast", "warmup_steps": -1, "dtype": "int8", "grad_clip": None}})
    assert [w.split(" ")[0] for w in wrong] == ["training.learning_rate", "training.max_steps", "training.grad_clip", "training.warmup_steps", "training.dtype"]
    assert len(validation.training_errors({})) == 7
    at = f"{tmp_path}/run.pth"
    assert validation.completion_errors(spark, at, 10) == [f"missing: {at}", f"missing: {tmp_path}/run.json"]
    (tmp_path / "run.pth").write_bytes(b"x")
    commit.put_json(spark, f"{tmp_path}/run.json", {"step": 9})
    assert validation.completion_errors(spark, at, 10) == ["step is 9, not 10"]
    commit.put_json(spark, f"{tmp_path}/run.json", {"step": 10, "max_steps": 10})
    assert validation.completion_errors(spark, at, 10) == []


# ---- arriving logs ----
def test_a_stream_of_logs_agrees_with_the_batch(spark, tmp_path):
    """Late, repeated and broken lines, corrections of old steps, and a restart between files."""
    draw = random.Random(8)
    lines = [{"run": draw.choice("ab"), "ord": i, "type": draw.choice(["train", "train", "validation", "other"]), "step": draw.randrange(25), "loss": draw.choice([round(draw.random(), 3), None]), "ok": draw.choice([True, False, False, None])} for i in range(240)]
    parts = [lines[k::2] for k in (1, 0)] + [lines[:40] + [{"run": "a", "ord": 999, "type": "validation", "step": 0, "loss": 0.0001, "ok": None}]]
    folder, out = tmp_path / "in", f"{tmp_path}/out"
    folder.mkdir()
    for i, part in enumerate(parts):
        (folder / f"{9 - i}.jsonl").write_text("\n".join(map(json.dumps, part)) + "\n{broken\n\n")
        arriving_logs.follow(arriving_logs.records(spark, str(folder)), out, f"{tmp_path}/c").awaitTermination()
    last = {}
    for r in sorted((r for p in parts for r in p if r["type"] != "other"), key=lambda r: r["ord"]):
        last[r["run"], r["type"], r["step"]] = (r["ord"], r["loss"], r["ok"])
    got = {(r.run, r.type, r.step): (r.ord, r.loss, r.ok) for r in commit.read(spark, f"{out}/latest").collect()}
    assert got == last
    bests, streaks = {}, {}
    for run in "ab":
        least, failed = None, 0
        for step in range(25):
            if (run, "validation", step) in last:
                loss = last[run, "validation", step][1]
                bests[run, step] = (loss, loss is not None and (least is None or loss < least))
                least = min((x for x in (least, loss) if x is not None), default=None)
            if (run, "train", step) in last:
                ok = last[run, "train", step][2] is not False
                failed = 0 if ok else failed + 1
                streaks[run, step] = (ok, failed, failed >= 10)
    assert {(r.run, r.step): (r.loss, r.improved) for r in commit.read(spark, f"{out}/bests").collect()} == bests
    assert {(r.run, r.step): (r.ok, r.failed, r.abort) for r in commit.read(spark, f"{out}/streaks").collect()} == streaks


# ---- candidates ----
def test_candidates_are_encoded_as_a_loop_does(spark):
    """The scored part of every prompt and choice of a table begins where its ids part from those of the prompt alone."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from lexmill import registry

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = lambda t: tok.encode(t, add_special_tokens=False).ids
    rows = registry.queries()["candidate_encoding"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 500
    for r in rows:
        choice = r.choice if r.choice.startswith(" ") else " " + r.choice
        alone, whole = encode(r.prompt), encode(r.prompt + choice)
        same = next((k for k, (a, b) in enumerate(zip(alone, whole)) if a != b), min(len(alone), len(whole)))
        cut = max(0, len(whole) - 1024)
        want = [k >= max(same - cut, 1) for k in range(len(whole) - cut)]
        assert list(r.ids) == whole[cut:] and list(r.mask) == want and r.target_tokens == sum(want)


def test_what_a_session_wrote_is_cleared(spark):
    from lexmill.sources import shared

    shared.clear(spark)
    kept = shared.stored(spark.range(5), "some")
    unused = shared.shared_path(spark, "none")
    assert kept.count() == 5 and not commit.exists(spark, unused)
    path = shared._given[spark.sparkContext.applicationId][0]
    assert commit.exists(spark, path) and shared.clear(spark) == 1 and not commit.exists(spark, path) and shared.clear(spark) == 0


def test_a_start_is_refused_with_all_that_is_wrong(spark, tmp_path):
    stream = spark.range(25).select((F.col("id") * 10).alias("start"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i.cast("int")).alias("ids"))
    folder = str(tmp_path / "t")
    training = {"batch_size": 8, "gradient_accumulation_steps": 1, "learning_rate": 1e-4, "max_steps": 10, "save_steps": 5, "grad_clip": 1.0, "dtype": "float32"}
    config = {"data": {"train_bin": folder}, "model": {"vocab_size": 10}, "training": training}
    with pytest.raises(ValueError, match="missing"):
        validation.ready(spark, config, 100)
    files.write_token_binary(stream, folder, 250, [], "t", items=100)
    assert validation.ready(spark, config, 100) == {"tokens": 250, "parts": 3, "vocab_size": 10}
    (tmp_path / "t" / "tokens-000002.bin").unlink()
    commit.put_json(spark, f"{folder}/state.json", {"tokens": 200, "target_tokens": 250})
    with pytest.raises(ValueError) as error:
        validation.ready(spark, {**config, "model": {"vocab_size": 9}, "training": {**training, "max_steps": 0}}, 100)
    said = str(error.value)
    assert all(x in said for x in ("config: training.max_steps is 0", "state: 200 tokens, not 250", "tokens-000002.bin: missing", "tokens-000000.bin: 10 ids outside the vocabulary, up to 9")), said
