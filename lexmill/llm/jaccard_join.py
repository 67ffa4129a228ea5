"""Jaccard similarity join over word n-grams by a MinHash LSH forest with exact verification.

A text's distinct word n-grams are hashed to 64 bits; texts with equal sets form one class from the start. A text's
signature has a path of ``depth`` MinHash values in each of ``trees`` prefix tries. A trie's nodes are the prefixes of its
paths. They are visited from the deepest up: prefixes are shortened level by level, until two texts at the threshold
share a node of some trie with the target recall. What a level does depends on what the levels below have found: only
nodes are opened that join texts which no tie connects yet, and a text is tied only where whole signatures say that it
is about as near as the threshold. At each level all texts of an open node are compared with one of them, which ties
dense groups with a row for each text; at the last level, those of nodes still open are compared with each other, in
blocks. Components of ties are then verified exactly, in blocks of bounded bytes, so no task holds an unbounded group
and no list of pairs is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import all_columns, as_rows, in_arrow, mix64, shared_folder, slices, small, written

#: Words kept hashed in a task, and n-grams signed at a time.
MEMO_WORDS, SIGN_ROWS = 100_000, 1024
#: Bytes of n-gram hashes, and texts, that one side of a block holds on average; texts of a side in a trie's node.
BLOCK_BYTES, BLOCK_TEXTS, NODE_TEXTS = 8 << 20, 128, 128
#: Edges of a node from which on they are joined apart.
HUB_EDGES = 256


@dataclass(frozen=True)
class Settings:
    """``step``: by how many values prefixes are shortened at a time. ``deviations``: how many standard deviations below
    the threshold a pair's signatures may agree and still tie it."""

    words: int = 5
    threshold: float = 0.8
    trees: int = 32
    depth: int = 12
    recall: float = 0.9999
    step: int = 3
    deviations: float = 5.0
    seed: int = 7

    def meet(self, depth: int) -> float:
        """The chance that two texts at the threshold share a node of some trie at this depth."""
        return 1 - (1 - self.threshold**depth) ** self.trees

    def depths(self) -> list[int]:
        """The lengths of prefixes, from ``depth`` down to the first with the target recall."""
        out = [self.depth]
        while self.meet(out[-1]) < self.recall:
            if out[-1] == 1:
                raise ValueError("too few trees for this recall")
            out.append(max(1, out[-1] - self.step))
        return out

    def agreement(self) -> int:
        """How many values of two signatures must agree."""
        n, t = self.trees * self.depth, self.threshold
        return int(np.ceil(n * t - self.deviations * np.sqrt(n * t * (1 - t))))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Sets of hashed word n-grams. Words are runs of bytes other than space and \\t..\\r."""

    def __init__(self, settings: Settings):
        self.settings, self.hashes = settings, _WordHashes()
        draw = np.random.default_rng(settings.seed)
        n = settings.trees * settings.depth
        self.odd = draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)

    def __reduce__(self):
        return Shingler, (self.settings,)

    def shingles(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct hashes; a text with fewer words than n gives one for all its words, one without words none."""
        words = (text or b"").split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = min(self.settings.words, len(h))
        grams = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            grams = mix64(grams + h[i : len(h) - n + 1 + i] + np.uint64(i))
        return np.unique(grams)

    def paths(self, grams: np.ndarray) -> bytes:
        """The signature: of each tree in turn, the path's values, a byte each."""
        high = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
        a, b = (self.odd >> np.uint64(32)).astype(np.uint32) | np.uint32(1), self.odd.astype(np.uint32)
        least = np.full(len(a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(high), SIGN_ROWS):
            part = high[i : i + SIGN_ROWS, None] * a
            part ^= part >> np.uint32(15)
            part *= b
            np.minimum(least, part.min(axis=0), out=least)
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


SIGNED = "doc_id long, class binary, n_grams long, paths binary"


def signed(docs: DataFrame, settings: Settings) -> DataFrame:
    """For each row: doc_id, the digest of its n-gram set (of the text itself if it has no words), n_grams, paths."""
    out = to_arrow_schema(StructType.fromDDL(SIGNED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = shingler.shingles(text)
                rows.append((doc_id, _digest(text, grams), len(grams), shingler.paths(grams) if len(grams) else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 4, out)], schema=out)

    return in_arrow(docs, run, SIGNED)


def _nodes(texts: DataFrame, depth: int, s: Settings) -> DataFrame:
    """Of each text (node, root, paths) and tree: the trie node of this depth that it is in, as a 64-bit key."""
    trees = texts.select("node", "root", "paths", F.explode(F.sequence(F.lit(0), F.lit(s.trees - 1))).alias("tree"))
    return trees.select(F.expr(f"xxhash64(tree, substring(paths, tree * {s.depth} + 1, {depth}))").alias("key"), "node", "root")


def _open(nodes: DataFrame) -> DataFrame:
    """The trie nodes that join texts of different roots, and the least text of each."""
    return nodes.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("node").alias("hub")).where("x <> y").select("key", "hub")


def _merged(roots: DataFrame, ties: DataFrame) -> DataFrame:
    """``roots`` (node, root) after one step along the ``ties`` (a, b) between roots: each root becomes the least that it is tied to."""
    both = ties.unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b")))
    new = written(both.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("new")).where("new < root"), "merged")
    return written(roots.join(small(new, new.count()), "root", "left").select("node", F.coalesce("new", "root").alias("root")), "roots")


def _agreeing(paths: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many values of each two signatures agree."""
    out = np.empty((len(paths), len(others)), np.int32)
    for i in range(len(paths)):
        out[i] = (others == paths[i]).sum(axis=1, dtype=np.int32)
    return out


def _signatures(column: pa.Array) -> np.ndarray:
    blob = b"".join(column.to_pylist())
    return np.frombuffer(blob, np.uint8).reshape(len(column), -1)


def _star_ties(texts: DataFrame, roots: DataFrame, depth: int, s: Settings) -> DataFrame:
    """Ties (a, b) between roots: of each text in an open node with the least text there, if their signatures agree."""
    nodes = _nodes(texts.join(small(roots, roots.count()), "node"), depth, s)
    opened = written(_open(nodes).join(roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub"), "open")
    met = nodes.join(small(opened, opened.count()), "key").where("root <> hub_root").select("node", "root", "hub", "hub_root").distinct()
    met = written(met, "met")
    hubs = met.select("hub").distinct()
    n_hubs = hubs.count()
    hub_paths = texts.join(small(hubs.withColumnRenamed("hub", "node"), n_hubs), "node").select(F.col("node").alias("hub"), F.col("paths").alias("hub_paths"))
    pairs = texts.join(small(met, met.count()), "node").join(small(hub_paths, n_hubs, 512), "hub")
    least = s.agreement()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            if batch.num_rows:
                agree = (_signatures(batch.column("paths")) == _signatures(batch.column("hub_paths"))).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(agree >= least))

    return in_arrow(pairs.select(F.col("root").alias("a"), F.col("hub_root").alias("b"), "paths", "hub_paths"), near, "a long, b long").distinct()


def _block_ties(texts: DataFrame, roots: DataFrame, depth: int, s: Settings) -> DataFrame | None:
    """Ties (a, b) between roots: of all texts of different roots that share an open node, if their signatures agree.

    Texts of a node are dealt into blocks of about NODE_TEXTS; those of a root with as many have blocks of their own, so
    that what is already tied is neither moved nor compared. Of trie nodes with the same texts one is taken.
    """
    nodes = _nodes(texts.join(small(roots, roots.count()), "node"), depth, s)
    opened = written(_open(nodes).select("key"), "open")
    n_open = opened.count()
    if not n_open:
        return None
    inside = written(nodes.join(small(opened, n_open), "key"), "inside")
    one_each = inside.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.col("node").cast("decimal(20,0)")).alias("y")).groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    keys = written(one_each.select("key"), "keys")
    by_root = written(inside.join(small(keys, n_open), "key").groupBy("key", "root").agg(F.count("*").alias("c")), "by_root")
    rest = by_root.groupBy("key").agg(F.sum(F.when(F.col("c") < NODE_TEXTS, F.col("c")).otherwise(0)).alias("rest"))
    n_roots = by_root.count()
    placed = by_root.join(small(rest, n_open), "key")
    own = F.xxhash64("root", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / NODE_TEXTS)))
    shared = F.pmod(F.xxhash64("root"), F.ceil(F.col("rest") / NODE_TEXTS))
    label = F.when(F.col("c") < NODE_TEXTS, shared).otherwise(own).alias("label")
    members = written(inside.join(small(placed, n_roots), ["key", "root"]).select("key", "node", "root", label), "labelled")
    labels = written(members.groupBy("key", "label").agg(F.min("root").alias("x"), F.max("root").alias("y")), "labels")
    other = labels.select("key", F.col("label").alias("label2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = labels.join(other, "key").where("label <= label2 and not (x = y and x2 = y2 and x = x2)").select("key", "label", "label2", F.xxhash64("key", "label", "label2").alias("unit"))
    sides = pairs.select("key", F.explode(F.array_distinct(F.array(F.struct("label", F.lit(0).alias("side")), F.struct(F.col("label2").alias("label"), F.when(F.col("label") == F.col("label2"), 0).otherwise(1).alias("side"))))).alias("s"), "unit").select("key", "s.label", "s.side", "unit")
    sides = written(sides, "sides")
    dealt = members.join(small(sides, sides.count()), ["key", "label"]).select("unit", "side", "node", "root").join(texts, "node")
    least = s.agreement()

    def tied(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        side, roots_, paths = rows.column("side").to_numpy(), rows.column("root").to_numpy(), _signatures(rows.column("paths"))
        same = side[-1] == 0
        x, y = (slice(None), slice(None)) if same else (side == 0, side == 1)
        linked = (_agreeing(paths[x], paths[y]) >= least) & (roots_[x][:, None] != roots_[y][None, :])
        labels_ = _labels(linked, [roots_[x], roots_[y]], same)
        a, b = np.concatenate([roots_[x], roots_[y]]), np.concatenate(labels_)
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the unit that is being read
        for batch in batches:
            units = batch.column("unit").to_numpy()
            cuts = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), len(units)]
            for i, j in zip(cuts, cuts[1:]):
                if held and j > i and held[-1].column("unit")[0].as_py() != units[i]:
                    yield tied(pa.Table.from_batches(held))
                    held = []
                if j > i:
                    held.append(batch.slice(i, j - i))
        if held:
            yield tied(pa.Table.from_batches(held))

    return in_arrow(dealt.repartition("unit").sortWithinPartitions("unit", "side", "node"), run, "a long, b long").distinct()


def forest_roots(texts: DataFrame, s: Settings) -> DataFrame:
    """Of each text (node, paths) that a tie of the forest connects with others: node, root (the least text connected)."""
    roots = written(texts.select("node", F.col("node").alias("root")), "roots")
    ties, depths = [], s.depths()
    for depth in depths:
        ties.append(written(_star_ties(texts, roots, depth, s), "ties"))
        if not ties[-1].isEmpty():
            roots = _merged(roots, ties[-1])
    blocks = _block_ties(texts, roots, depths[-1], s)
    if blocks is not None:
        ties.append(written(blocks, "ties"))
    return written(components(reduce(DataFrame.unionByName, ties)), "near")


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the least neighbour of their ``a``. Those of nodes with many are joined by a broadcast, if its size allows."""
    least = written(least, "least")
    hubs = least.where(F.col("n") > HUB_EDGES).drop("n")
    n, least = hubs.count(), least.drop("n")
    if not n:
        return edges.join(least, "a")
    others = edges.join(small(hubs.select("a"), n), "a", "left_anti").join(least, "a")
    return others.unionByName(edges.join(small(hubs, n), "a"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) edges between longs: node, root (the component's least node).

    Alternating large-star and small-star steps, each written to the checkpoint folder; ends when a step changes
    nothing. Edges stay as many as nodes at most. A hot node's edges are combined before each aggregation's shuffle, and
    are not shuffled for joins while the list of hot nodes is within the bound of broadcasts.
    """
    shared_folder(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")).withColumn("least", F.least("a", "least"))
        large = _with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        to = large.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))
        near = _with_least(large, to).select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        nxt = near.unionByName(to.select("a", F.col("least").alias("b"))).distinct().checkpoint()
        size = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == before:
            return nxt.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(nxt.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now, before = nxt, size


def _verify(settings: Settings):
    """Counts the links of each text of a pair of blocks, and ties linked texts by as few edges as connect them."""
    threshold = settings.threshold

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        same = bool((frame["i"] == frame["j"]).iloc[0])
        frame = frame.sort_values("node")
        frame = frame.drop_duplicates("node")  # a repeated row is fetched as often as it stands
        sides = [frame[frame["block"] == frame["i"]]] * 2 if same else [frame[frame["block"] == frame[k]] for k in ("i", "j")]
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame({"node": [], "links": [], "tied": []})
        sets = [[np.frombuffer(x, "<u8") for x in s["grams"]] for s in sides]
        sizes = [np.array([len(x) for x in s]) for s in sets]
        shared = np.intersect1d(*(np.unique(np.concatenate(s)) for s in sets), assume_unique=True)
        rows = [np.repeat(np.arange(len(s)), n) for s, n in zip(sets, sizes)]
        grams = [np.concatenate(s) for s in sets]
        both = np.zeros((len(sets[0]), len(sets[1])), np.float32)
        slots = [np.searchsorted(shared, g) for g in grams]
        hit = [np.flatnonzero((p < len(shared)) & (shared[np.minimum(p, len(shared) - 1)] == g)) if len(shared) else np.empty(0, int) for p, g in zip(slots, grams)]
        for at in range(0, len(shared), 2048):  # dense strips of the text-by-gram matrices
            strips = []
            for s, p, r, h in zip(sets, slots, rows, hit):
                inside = h[(p[h] >= at) & (p[h] < at + 2048)]
                strip = np.zeros((len(s), 2048), np.float32)
                strip[r[inside], p[inside] - at] = 1
                strips.append(strip)
            both += strips[0] @ strips[1].T
        linked = both >= threshold * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-6
        if same:
            np.fill_diagonal(linked, False)
        nodes, weights = [s["node"].to_numpy() for s in sides], [s["copies"].to_numpy() for s in sides]
        labels = _labels(linked, nodes, same)
        out = [pd.DataFrame({"node": nodes[0], "links": linked @ weights[1], "tied": labels[0]})]
        if not same:
            out.append(pd.DataFrame({"node": nodes[1], "links": linked.T @ weights[0], "tied": labels[1]}))
        return pd.concat(out)

    return run


def _labels(linked: np.ndarray, reps: list[np.ndarray], same: bool) -> list[np.ndarray]:
    """The least text of each text's component within the links of two blocks."""
    most = np.iinfo(np.int64).max
    x, y = reps
    while True:
        new_x = np.minimum(x, np.where(linked, y[None, :], most).min(axis=1))
        new_y = new_x if same else np.minimum(y, np.where(linked, new_x[:, None], most).min(axis=0))
        if (new_x == x).all() and (new_y == y).all():
            return [x, y]
        x, y = new_x, new_y


def _blocks(total_bytes: Column, texts: Column) -> Column:
    return F.greatest(F.ceil(total_bytes / BLOCK_BYTES), F.ceil(texts / BLOCK_TEXTS), F.lit(1)).cast("int")


def _classified(docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and of those with an id: doc_id, class, root (a number of its connected classes), class_id, n_links."""
    s = settings
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    marks = written(signed(plain, s), "signed")
    known = marks.where("doc_id is not null")
    firsts = known.groupBy("class").agg(F.min(F.struct("doc_id", "n_grams", "paths")).alias("first"), F.count("*").alias("copies"))
    # a class is known by a number of its own, as several may have the same least doc_id
    classes = written(firsts.select("class", F.monotonically_increasing_id().alias("node"), F.col("first.doc_id").alias("rep"), "first.n_grams", "first.paths", "copies"), "classes")
    reps = classes.where("n_grams > 0")
    near = forest_roots(reps.select("node", "paths"), s)
    n_near = near.count()
    members = written(reps.select("class", "node", "rep", "copies", "n_grams").join(small(near, n_near), "node"), "members")
    sizes = members.groupBy("root").agg(_blocks(F.sum(F.col("n_grams") * 8), F.count("*")).alias("blocks"))
    placed = written(members.join(small(sizes, sizes.count()), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")), "placed")
    # one text of each candidate class, as hashed n-grams
    texts = plain.join(small(placed.withColumnRenamed("rep", "doc_id"), placed.count(), 128), "doc_id")
    place = "node long, root long, copies long, block int, blocks int, grams binary"
    out = to_arrow_schema(StructType.fromDDL(place))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(s)
        for batch in slices(batches):
            made = [shingler.shingles(t).tobytes() for t in batch.column("text").to_pylist()]
            right = pa.array([xxhash.xxh128_digest(x) == k for x, k in zip(made, batch.column("class").to_pylist())], pa.bool_())
            rows = pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("node", "root", "copies", "block", "blocks")), pa.array(made, pa.binary())], schema=out)
            yield rows.filter(right)

    dealt = (
        in_arrow(texts.select("node", "class", "root", "copies", "block", "blocks", "text"), grams, place)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    )
    checked = written(dealt.groupBy("root", "i", "j").applyInPandas(_verify(s), "node long, links long, tied long"), "checked")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    final = written(components(checked.where("tied <> node").select(F.col("node").alias("a"), F.col("tied").alias("b"))), "final")
    ids = written(final.join(placed.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("class_id")), "ids")
    checks = final.join(small(ids, ids.count()), "root").join(links, "node", "full").select("node", "root", "class_id", "links")
    verdict = classes.select("class", "node", "rep", "copies").join(small(checks, n_near), "node", "left")
    verdict = written(verdict.select("class", F.coalesce("root", "node").alias("root"), F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "verdict")
    return marks, known.select("doc_id", "class").join(verdict, "class")


def similar(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, class_id, n_links.

    Two documents are linked if the Jaccard index of their word n-gram sets is at least the threshold. ``class_id`` is
    the least doc_id of those connected by links; ``n_links`` counts a row's links to other rows, copies included.
    Equal sets are always linked. Texts without words (null counts as empty) are linked only to equal ones. A row with
    a null id has class_id null and n_links 0 and counts for nobody. Repeated rows count as copies. An empty table gives
    an empty result; other columns are not read. Different texts under one id are judged each; classes that are not
    connected can then have the same ``class_id``.

    Copies meet in an aggregation that is combined before its shuffle, and never in pairs. The forest's ties hold all
    links up to the recall (for a pair just at the threshold; higher for closer ones); every link counted is exact. Work
    within a component of different texts grows with the square of its blocks of BLOCK_TEXTS, because a count of links
    needs each; rows moved grow with its size times its blocks. Texts that share a node of the last level without being
    near are compared by signatures with the square of the node's blocks of NODE_TEXTS.
    """
    marks, judged = _classified(docs, settings, id_col, text_col)
    got = judged.select("doc_id", "class_id", "n_links")
    none = marks.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return got.unionByName(none)


def _digest(text: bytes | None, grams: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(grams.tobytes() if len(grams) else b"\0" + (text or b""))


def digests(docs: DataFrame, settings: Settings):
    """A function of a binary column: the digest of a text's class."""

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        shingler = Shingler(settings)
        return pd.Series([_digest(t, shingler.shingles(t)) for t in texts])

    return digest


def distinct_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` less those that are not the first of their class: of each class, one row of its least doc_id stays.

    Rows with a null id stay; where several rows of a class have the least id, the one with the least text does. Different
    texts under one id are judged each.
    """
    marks, judged = _classified(docs, settings, "doc_id", "text")
    repeated = written(marks.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    n = repeated.count()
    gone = written(judged.where("doc_id <> class_id").select("doc_id").unionByName(repeated).distinct(), "gone")
    kept = docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(*all_columns(docs))
    if not n:
        return kept
    # rows that share an id are told apart by the digest of their class
    firsts = judged.where("doc_id = class_id").join(small(repeated, n), "doc_id", "left_semi").select("doc_id", "class", "root").distinct()
    rows = docs.join(small(repeated, n), "doc_id", "left_semi").select(as_rows(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), digests(docs, settings)(F.col("text").cast("binary")).alias("class"))
    turn = F.struct(F.coalesce("row.text", F.lit("")), F.xxhash64(*[F.col("row")[c] for c in docs.columns]))
    one = rows.join(firsts, ["doc_id", "class"]).groupBy("root").agg(F.min_by("row", turn).alias("row"))
    return kept.unionByName(one.select("row.*"))
