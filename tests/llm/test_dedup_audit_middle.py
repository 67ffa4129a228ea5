"""Filter audit, suffix dedup and fill-in-the-middle against brute force, and on odd rows and empty tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import fill_in_middle, filter_audit, queries, suffix_dedup
from lexmill.llm.suffix_dedup import Settings

from .conftest import ROWS, SCHEMA

DATA = "/root/testdata/sf0.01"


# ---- 11 ----
def plain_audit(docs, labels):
    fails, parts = [], []
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        fails.append({
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        })
        parts.append(part or "")
    out = {}
    for part in set(parts):
        rows = [(f, labels.get(i, (None, None))) for f, p, (i, _, _) in zip(fails, parts, docs) if p == part]
        shapley = Counter()
        made = []
        for order in itertools.permutations("ABCDE"):
            alive, dead = rows, []
            for step, name in enumerate(order, 1):
                gone = [r for r in alive if r[0][name]]
                redundant = sum(r[0][name] for r in dead)
                alive, dead = [r for r in alive if not r[0][name]], dead + gone
                shapley[name] += len(gone)
                alone = sum(r[0][name] and sum(r[0].values()) == 1 for r in rows)
                made.append((("".join(order), step, name), (len(alive), len(gone), redundant, alone, sum(r[1][0] == 1 for r in gone), sum(r[1][1] == 1 for r in gone))))
        for (order, step, name), figures in made:
            out[part, order, step] = (*figures, shapley[name])
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_equals_all_orders_applied_one_by_one(spark):
    words = lambda n, k: " ".join(f"w{i % k}" for i in range(n))
    docs = [
        (1, words(120, 120), "en"), (2, words(120, 120), "en"), (None, words(120, 120), "en"), (3, words(120, 10), "de"), (4, "ALL UPPER #", "de"), (5, None, None), (6, "", None),
        (6, "", ""), (7, words(99, 99) + " \x85 *", "en"), (8, words(120, 120) + " &", "en"), (9, "ALL UPPER #", "fr"), (4, "ALL UPPER #", "de"), (10, words(100, 80), "fr"), (11, words(101, 80), "fr"),
        (12, "A" + "b" * 9, "en"), (13, "A" + "b" * 8, "en"), (14, "é ä\U0001f600 " * 60, "de"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (4, 1, 0), (9, 0, 1), (None, 1, 1), (10, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({n: F.lit("clash") for n in ("part", "fails", "digest", "first", "good", "toxic", "id", "step")})
    known = defaultdict(lambda: (0, 0))
    for i, q, t in labels:
        if i is not None:
            known[i] = (max(known[i][0], q or 0), max(known[i][1], t or 0))
    got = audited(filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == plain_audit(docs, dict(known)) and len(got) == 4 * 600


def test_audit_of_odd_rows_and_of_none(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(filter_audit.audit(odd, none)) == plain_audit([(r[0], r[1], r[2]) for r in ROWS], {})
    assert filter_audit.audit(empty, none).count() == 0


def test_edges_are_visited_once(spark):
    rows = [("x", False, False, m) for m in range(32) for _ in range(m % 3 + 1)]
    found = filter_audit.edges(spark.createDataFrame(rows, "part string, good boolean, toxic boolean, fails int")).collect()
    assert Counter((r.applied, r.filter) for r in found) == Counter((a, i) for a in range(32) for i in range(5) if not a >> i & 1)
    assert all(r.removed == sum(1 for x in rows if x[3] & r.applied == 0 and x[3] >> r.filter & 1) for r in found)
    total = sum(r.removed * math.factorial(bin(r.applied).count("1")) * math.factorial(4 - bin(r.applied).count("1")) for r in found)
    assert total == 120 * sum(1 for x in rows if x[3])  # all orders remove the same documents in the end


# ---- 12 ----
def plain_dedup(rows, width):
    """(id, text): (bytes, removed, spans, digest of the rest), by a set of all strings seen; equal rows are one document."""
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = t.encode()
        covered = bytearray(len(raw))
        for k in range(len(raw) - width + 1):
            if raw[k : k + width] in seen:
                covered[k : k + width] = b"\1" * width
            seen.add(raw[k : k + width])
        kept = bytes(c for c, x in zip(raw, covered) if not x)
        out[i, t] = (len(raw), sum(covered), sum(1 for k, x in enumerate(covered) if x and not (k and covered[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def deduped(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


@given(st.binary(max_size=300).map(lambda b: bytes(c % 3 for c in b)), st.integers(8, 20))
@settings(max_examples=150, deadline=None)
def test_two_stage_order(raw, width):
    order = suffix_dedup.suffix_order(np.frombuffer(raw, np.uint8), width).tolist()
    assert sorted(order) == list(range(len(raw)))
    whole = [raw[i : i + width] for i in order if i + width <= len(raw)]
    assert whole == sorted(whole)


def test_two_stage_order_of_runs_and_all_bytes():
    for raw in (b"", b"a", b"a" * 5000, b"ab" * 3000, bytes(range(256)) * 9, b"\xff" * 300 + b"\0" * 300, b"z" * 400 + b"y" + b"z" * 400):
        order = suffix_dedup.suffix_order(np.frombuffer(raw, np.uint8), 16).tolist()
        whole = [raw[i : i + 16] for i in order if i + 16 <= len(raw)]
        assert sorted(order) == list(range(len(raw))) and whole == sorted(whole)


@given(st.lists(st.binary(min_size=12, max_size=60).map(lambda b: bytes(c % 2 for c in b)), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_copies_of_a_block(stretches):
    width, n = 12, [len(x) - 11 for x in stretches]
    begins = np.cumsum([0, *map(len, stretches)])[:-1]
    rank = np.arange(len(stretches))[::-1].copy()  # the last stretch comes first
    got = set()
    for of, at, many in zip(*suffix_dedup.copies(np.frombuffer(b"".join(stretches), np.uint8), begins, np.array(n), rank, width)):
        got |= {(int(of), int(at) + k) for k in range(many)}
    seen, want = set(), set()
    for i in reversed(range(len(stretches))):
        for k in range(n[i]):
            s = stretches[i][k : k + width]
            want |= {(i, k)} if s in seen else set()
            seen.add(s)
    assert got == want


@given(st.binary(min_size=12, max_size=150).map(lambda b: bytes(c % 2 for c in b)), st.booleans())
@settings(max_examples=150, deadline=None)
def test_stretches_of_one_anchor(raw, repeats):
    """Every string is in one stretch, all strings of a stretch have its anchor, and INNER says whether that stands in it twice."""
    raw = (raw[:7] * 30)[:150] if repeats else raw
    data = np.frombuffer(raw, np.uint8)
    start, n, anchor, _ = suffix_dedup.stretches(data, np.zeros(len(raw), int), Settings(width=12, anchor=5))
    hashes = suffix_dedup.SpanHashes(data, len(data)).all(5)
    lengths = n % suffix_dedup.INNER
    assert [a + k for a, m in zip(start, lengths) for k in range(m)] == list(range(len(raw) - 11))
    for a, k, inner, least in zip(start, lengths, n >= suffix_dedup.INNER, anchor):
        assert all(hashes[i : i + 8].min() == least for i in range(a, a + k)) and inner == ((hashes[a : a + k + 7] == least).sum() > 1)


@pytest.mark.parametrize("chosen", [Settings(), Settings(block_stretches=2), Settings(anchor=16, block_stretches=0)])
def test_dedup_equals_brute_force(spark, chosen):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = plain_dedup([(r.doc_id, r.text) for r in docs.collect()], 100)
    got = deduped(suffix_dedup.digests(docs, chosen))
    assert {i: v for (i, _), v in want.items()} == got and sum(v[1] for v in got.values()) > 100_000


def test_dedup_of_planted_strings(spark):
    """Exactly 99 and 100 bytes in common; strings that start in themselves; strings across documents, which do not count."""
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß€") for _ in range(n))
    p = "".join(rng.choice("abcdef") for _ in range(400))
    rows = [
        (1, noise(50) + p + noise(50)), (2, noise(30) + p[:100] + noise(30)), (3, noise(30) + p[:99] + "!" + noise(30)), (4, p[200:301]), (5, p[:60]), (6, p[60:160]), (7, p[10:110] + p[10:110]),
        (8, "xy" * 4000), (9, "xy" * 4000 + "z"), (10, " " * 300_000), (11, None), (12, ""), (13, "€" * 200), (14, "€" * 33), (15, "q" * 100), (16, "q" * 101), (17, "q" * 99),
        (18, (noise(500) + "\n") * 7), (19, noise(20) + p + p), *[(100 + i, noise(40) + p[50:250] + noise(40)) for i in range(60)],
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = {i: v for (i, _), v in plain_dedup(rows, 100).items()}
    for chosen in (Settings(), Settings(block_stretches=5)):
        assert deduped(suffix_dedup.digests(df, chosen)) == want
    spans = {r.doc_id: r for r in suffix_dedup.trimmed(df).collect()}
    for i, t in rows:
        raw, r = (t or "").encode(), spans[i]
        at, kept = 0, b""
        for s in r.spans:
            kept, at = kept + raw[at : s["start"]], s["end"]
        assert kept + raw[at:] == bytes(r.kept) and hashlib.sha256(bytes(r.kept)).hexdigest() == want[i][3]


def test_dedup_under_shared_ids(spark):
    """Of different texts under one id one comes first; equal rows are one document and get its result."""
    a, b = "".join(map(str, range(60))), "".join(map(str, range(500, 560)))
    rows = [(1, a + b), (1, a + "-" + b), (1, a + b), (None, a), (2, b), (2, b), (0, "short")]
    got = Counter(tuple(r)[:3] for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n, k = len(a), len(b)
    first = {(1, n + k, 0): 2, (1, n + k + 1, n + k): 1}, {(1, n + k, n + k): 2, (1, n + k + 1, 0): 1}
    rest = Counter({(None, n, n): 1, (2, k, k): 2, (0, 5, 0): 1})
    assert got in [Counter(f) + rest for f in first]


def test_dedup_of_odd_rows_and_of_none(spark, odd, empty):
    want = plain_dedup([(r[0], r[1]) for r in ROWS], 100)
    got = Counter(tuple(r) for r in suffix_dedup.digests(odd).collect())
    assert got == Counter((r[0], *want[r[0], r[1] or ""]) for r in ROWS)
    assert suffix_dedup.digests(empty).count() == 0 and suffix_dedup.trimmed(empty).count() == 0
    assert suffix_dedup.digests(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2


def test_marks_are_judged_alike_in_batches_of_any_size(spark):
    rng = random.Random(5)
    marks = sorted({(rng.randrange(9), rng.randrange(3), rng.randrange(6), 0, rng.randrange(40) * 7) for _ in range(300)})
    n = [rng.choice([3, 3, 3 + suffix_dedup.INNER, -4]) for _ in marks]
    schema = pa.schema([(c, pa.int64()) for c in ("m", "s", "kid", "tie", "start")] + [("n", pa.int32())])
    out = pa.schema([("copy", pa.bool_()), *[(c, pa.int64()) for c in ("m", "kid", "tie", "start")], ("n", pa.int32())])
    whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*zip(*marks), n], schema)], schema=schema)
    results = []
    for size in (1, 2, 7, 1000):
        parts = [whole.slice(i, size) for i in range(0, whole.num_rows, size)]
        results.append(Counter(tuple(r.values()) for b in suffix_dedup._judge(iter(parts), out) for r in b.to_pylist()))
    want, known = Counter(), [(x, k) for x, k in zip(marks, n) if k > 0]
    for x, k in zip(marks, n):
        want[True, x[0], *x[2:], -k] += k < 0
    for (m, s), group in itertools.groupby(known, lambda r: r[0][:2]):
        group = list(group)
        others = {x[1] for x, _ in known if x[0] == m}
        for (x, k) in group[1:]:
            want[True, m, *x[2:], k % suffix_dedup.INNER] += 1
        if len(others) > 1 or group[0][1] >= suffix_dedup.INNER:
            want[False, m, *group[0][0][2:], group[0][1] % suffix_dedup.INNER] += 1
    assert results == [+want] * 4


@given(st.lists(st.binary(max_size=160).map(lambda b: bytes(c % 2 for c in b)), min_size=1, max_size=8), st.integers(0, 3), st.data())
@settings(max_examples=120, deadline=None)
def test_steps_of_dedup_over_small_chunks(texts, repeats, data):
    """All steps without Spark, texts in chunks of 37 bytes, marks combined at any time and judged in small batches."""
    chosen = Settings(width=12, anchor=5)
    texts = [t[:9] * 20 if i < repeats else t for i, t in enumerate(texts)]
    ids = data.draw(st.permutations(range(len(texts))))
    marks_schema = pa.schema([(c, pa.int64()) for c in ("m", "s", "kid", "tie", "start")] + [("n", pa.int32())])
    found_schema = pa.schema([("copy", pa.bool_()), *[(c, pa.int64()) for c in ("m", "kid", "tie", "start")], ("n", pa.int32())])
    rows = pa.RecordBatch.from_pydict({"kid": pa.array(ids, pa.int64()), "tie": pa.array([0] * len(ids), pa.int64()), "raw": pa.array(texts, pa.binary())})
    chunk, combined = suffix_dedup.CHUNK, suffix_dedup.COMBINED
    suffix_dedup.CHUNK, suffix_dedup.COMBINED = 37, data.draw(st.sampled_from([1, 100, 10_000]))
    try:
        at = data.draw(st.integers(0, len(texts)))
        marks = pa.Table.from_batches(list(suffix_dedup._mark(iter([rows.slice(0, at), rows.slice(at)]), marks_schema, chosen)), marks_schema)
    finally:
        suffix_dedup.CHUNK, suffix_dedup.COMBINED = chunk, combined
    marks = marks.sort_by([(c, "ascending") for c in ("m", "s", "kid", "tie", "start")])
    parts = [b for b in marks.to_batches(max_chunksize=3) if b.num_rows]
    found = [r for b in suffix_dedup._judge(iter(parts), found_schema) for r in b.to_pylist()]
    text_of, runs = dict(zip(ids, texts)), Counter()
    for r in found:
        if r["copy"]:
            runs[r["kid"], r["start"], r["n"]] += 1
    wanted = sorted((r for r in found if not r["copy"]), key=lambda r: r["m"])
    stretch = pa.RecordBatch.from_pydict({
        **{c: pa.array([r[c] for r in wanted], pa.int64()) for c in ("m", "kid", "tie", "start")}, "n": pa.array([r["n"] for r in wanted], pa.int32()),
        "raw": pa.array([text_of[r["kid"]][r["start"] : r["start"] + r["n"] + 11] for r in wanted], pa.binary()),
    })
    runs_schema = pa.schema([(c, pa.int64()) for c in ("kid", "tie", "start")] + [("n", pa.int32())])
    for b in suffix_dedup._sort_blocks(iter([stretch]), runs_schema, chosen):
        for r in b.to_pylist():
            runs[r["kid"], r["start"], r["n"]] += 1
    got = {i: suffix_dedup.merged([(a, a + n + 11) for k, a, n in runs if k == i]) for i in ids}
    seen, want = set(), {}
    for i in sorted(ids):
        copies = []
        for k in range(len(text_of[i]) - 11):
            string = text_of[i][k : k + 12]
            copies += [(k, k + 12)] if string in seen else []
            seen.add(string)
        want[i] = suffix_dedup.merged(copies)
    assert got == want


# ---- 13 ----
def plain_middle(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    text = text or ""
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@given(st.integers(0, 10**6), st.text(st.sampled_from("ab<PSM>ä\n😀 "), max_size=40))
@settings(max_examples=300, deadline=None)
def test_middle_of_any_text(doc_id, text):
    made = fill_in_middle.transform(doc_id, text)
    assert (made.n, made.form, made.prefix_chars, made.middle_chars, made.output) == plain_middle(doc_id, text)
    assert fill_in_middle.restored(made.output, made.form) == text


def test_middle_of_a_pattern_that_leaves_a_rest():
    for i in range(40):
        made = fill_in_middle.transform(i, "ab cd ef..", regex.compile(r"[a-z]+ ?"))
        assert made.n == 3 and fill_in_middle.restored(made.output, made.form) == "ab cd ef.."


def test_middle_of_odd_rows_and_of_none(spark, odd, empty):
    more = odd.unionByName(spark.createDataFrame([(8, "a <P> b", "en", "a", 1), (9, "€" * 100_000 + "x y", "en", "a", 1)], SCHEMA), allowMissingColumns=True)
    rows = [*ROWS, (8, "a <P> b"), (9, "€" * 100_000 + "x y")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for i, t, *_ in rows:
        *figures, output = plain_middle(i, t)
        want[(i, *figures, sha(output), sha(t or ""))] += 1
    assert Counter(map(tuple, fill_in_middle.digests(more).collect())) == want
    made = fill_in_middle.transformed(more)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.text) for r in made.collect()) == Counter((i, *plain_middle(i, t)) for i, t, *_ in rows)
    assert set(made.columns) == {*more.columns, "n", "form", "prefix_chars", "middle_chars"} and made.where("found = 'clash' and made_ is null").count() == len(ROWS) if "made_" in made.columns else True
    assert fill_in_middle.digests(empty).count() == 0 and fill_in_middle.transformed(empty).count() == 0


def test_middle_of_the_table_is_rebuilt(spark):
    rows = queries.op13_fill_in_middle(spark, DATA).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert all(r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows) and {r.form for r in rows} == {"plain", "psm", "spm"}
