"""Registered queries of arrival order, stored tables, indexed lines, manifests and token binaries, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quota
from ..operators.buffered import buffered
from ..operators.sampler import Sampler
from ..sources import commit, files, indexed
from ..sources.arrival import arrived
from ..sources.shared import shared_path
from ..streaming import logs as arriving_logs
from . import artifacts, validation
from . import sql as S
from .document_queries import FLAT, ID, stream, token_id

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def in_order(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents with their arrival; the tables that the SQL reads lie in order of doc_id."""
    return arrived(spark, f"{sf_dir}/documents.parquet").select(*columns, "arrival")


ARRIVED = "a AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS arrival, count(*) OVER () AS size FROM documents)"


@query(f"""WITH {ARRIVED}, c AS (SELECT arrival, source, len({S.words('text')})::BIGINT AS n FROM a WHERE source IS NOT NULL),
t AS (SELECT source, sum(n)::BIGINT AS s FROM c GROUP BY 1),
q AS (SELECT source, (s // 2 + CASE WHEN row_number() OVER (ORDER BY source DESC) = 1 THEN sum(s) OVER () // 2 - sum(s // 2) OVER () ELSE 0 END)::BIGINT AS quota FROM t),
r AS (SELECT c.*, quota, sum(n) OVER (PARTITION BY source ORDER BY arrival)::BIGINT AS through FROM c JOIN q USING (source))
SELECT source, quota, count(*) AS n_docs, sum(least(n, quota - (through - n)))::BIGINT AS tokens, min(arrival)::BIGINT AS first_arrival, max(arrival)::BIGINT AS last_arrival
FROM r WHERE through - n < quota AND n > 0 GROUP BY ALL""")
def arrival_quota(spark, sf_dir):
    """Quotas over a table taken without its ids, in the order that its files lie in."""
    d = T.once(in_order(spark, sf_dir, "text", "source").where("source is not null"), n=F.size(T.words(F.col("text"))).cast("long")).select("arrival", "source", "n")
    rows = quota.running(quota.with_quota(d, quota.share_table(d)), "n", "arrival", "source", in_order(spark, sf_dir))
    cut = quota.exact_cut(rows).groupBy("source", "quota")
    return cut.agg(F.count("*").alias("n_docs"), F.sum("taken").alias("tokens"), F.min("arrival").alias("first_arrival"), F.max("arrival").alias("last_arrival"))


BUFFER = 100


@query(f"""WITH {ARRIVED},
s AS (SELECT *, CASE WHEN arrival < {BUFFER} THEN arrival ELSE ('0x' || substr(md5('5:' || arrival), 1, 8))::BIGINT % {BUFFER} END AS slot FROM a),
x AS (SELECT *, lead(arrival) OVER (PARTITION BY slot ORDER BY arrival) AS later FROM s)
SELECT doc_id, source, CASE WHEN later IS NOT NULL THEN later - {BUFFER}
  ELSE greatest(size - {BUFFER}, 0) + row_number() OVER (PARTITION BY later IS NULL ORDER BY md5('5:end:' || slot), slot) - 1 END::BIGINT AS place FROM x""")
def buffered_shuffle(spark, sf_dir):
    """The order of a shuffle with a buffer of 100 rows, place by place."""
    return buffered(in_order(spark, sf_dir, "doc_id", "source"), BUFFER, 5).select("doc_id", "source", "place")


@query("""SELECT 0 AS epoch, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, 0::BIGINT AS first_turn, count(*) - 1 AS last_turn FROM documents
UNION ALL SELECT 1, count(*) // 2, count(*) // 2, count(*), count(*) + count(*) // 2 - 1 FROM documents""")
def sampler_epochs(spark, sf_dir):
    """An epoch and a half of documents in seeded orders, stopped after a third and gone on with from the saved state."""
    d = in_order(spark, sf_dir, "doc_id")
    n = d.count()
    first, rest = Sampler(n, 123, "documents"), Sampler(n, 123, "documents")
    a = first.take(spark, n // 3)
    rest.load(first.state())
    b = rest.take(spark, n + n // 2 - n // 3).withColumn("turn", F.col("turn") + n // 3)
    drawn = a.unionByName(b).select("turn", "epoch", F.col("item").alias("arrival"))
    return d.join(drawn, "arrival").groupBy("epoch").agg(
        F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_docs"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn")
    )


@query(f"WITH {ARRIVED} SELECT arrival::BIGINT AS arrival, doc_id, sha256(text) AS text_sha256 FROM a")
def indexed_lines(spark, sf_dir):
    """Documents as JSONL, of which every line is read by its place, in a seeded order, through an index of byte offsets.

    Tasks read splits by their size and not in order, so rows go to ranges of doc_id before they are written.
    """
    folder, order = shared_path(spark, "lines"), F.col("doc_id").asc_nulls_last()
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartitionByRange(order).sortWithinPartitions(order)
    commit.write(rows.select(F.to_json(F.struct("doc_id", "text")).alias("value")), f"{folder}/table", format="text")
    listed, index = indexed.build(spark, commit.current(spark, f"{folder}/table")["files"], f"{folder}/index")
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    sizes = index.groupBy("file").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    n = index.count()
    turns = Sampler(n, 7).take(spark, n).select("turn", F.col("item").alias("arrival")) if n else spark.createDataFrame([], "turn long, arrival long")
    places = index.select("file", "line").join(quota.few(sizes), "file").select("file", "line", (F.col("before") + F.col("line")).alias("arrival"))
    got = indexed.lines_at(places.join(turns, "arrival").select("turn", "arrival", "file", "line"), listed, index)
    row = F.from_json("value", "doc_id long, text string")
    return got.select("arrival", row.alias("row")).select("arrival", "row.doc_id", F.sha2("row.text", 256).alias("text_sha256"))


@query(f"WITH {ARRIVED} SELECT (arrival + arrival // 10)::BIGINT AS line, doc_id, sha256(text) AS text_sha256 FROM a")
def numbered_lines(spark, sf_dir):
    """Documents as lines with a blank one after every ten, numbered over all files; blank lines count and are then left out.

    Tasks read splits by their size and not in order, so rows go to ranges of their arrival before they are written.
    """
    folder = shared_path(spark, "blank-lines")
    made = F.to_json(F.struct("doc_id", "text"))
    placed = in_order(spark, sf_dir, "doc_id", "text").repartitionByRange("arrival").sortWithinPartitions("arrival")
    rows = placed.select(F.explode(F.when(F.col("arrival") % 10 == 9, F.array(made, F.lit(""))).otherwise(F.array(made))).alias("value"))
    commit.write(rows, folder, format="text")
    found = files.lines(spark, commit.current(spark, folder)["files"])
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    sizes = found.groupBy("file").agg(F.count("*").alias("n")).select("file", before.alias("before"))
    kept = found.where(files.not_blank(F.col("value"))).join(quota.few(sizes), "file")
    row = F.from_json("value", "doc_id long, text string")
    return kept.select((F.col("before") + F.col("ord")).alias("line"), row.alias("row")).select("line", "row.doc_id", F.sha2("row.text", 256).alias("text_sha256"))


@query("SELECT count(*) AS n_rows, least(count(*), 100) AS largest, true AS reused, count(DISTINCT doc_id) AS n_ids FROM documents")
def shards_read_back(spark, sf_dir):
    """M1, M2, M4: JSONL shards of 100 rows at most, not written again when they are whole, and read back with all their rows."""
    folder = shared_path(spark, "jsonl")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    reused = artifacts.write_shards(rows, folder, 100) and not artifacts.write_shards(rows, folder, 100)
    back = spark.read.schema(rows.schema).json(folder).withColumn("file", F.col("_metadata.file_path"))
    each = back.groupBy("file").agg(F.count("*").alias("n"))
    one = back.agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_ids"), F.lit(1).alias("one"))
    return one.join(each.agg(F.max("n").alias("largest"), F.lit(1).alias("one")), "one").select("n_rows", "largest", F.lit(reused).alias("reused"), "n_ids")


@query(f"""WITH {ARRIVED}, l AS (SELECT arrival // 500 AS shard, arrival, doc_id || chr(9) || coalesce(source, '') || chr(9) || coalesce(n_chars, 0) || chr(10) AS line FROM a),
s AS (SELECT shard, count(*) AS n_lines, string_agg(line, '' ORDER BY arrival) AS content FROM l GROUP BY 1)
SELECT shard::BIGINT AS shard, n_lines, strlen(content) AS bytes, sha256(content) AS sha256 FROM s""")
def shard_manifest(spark, sf_dir):
    """Shards of 500 lines, and of each file its size and the SHA-256 that a task takes of it."""
    line = F.concat_ws("\t", "doc_id", F.coalesce("source", F.lit("")), F.coalesce("n_chars", F.lit(0)))
    d = in_order(spark, sf_dir, "doc_id", "source", "n_chars").select(F.floor(F.col("arrival") / 500).alias("shard"), "arrival", line.alias("value"))
    folder = shared_path(spark, "shards")
    shards = d.select("shard").distinct().count()
    d.repartition(max(1, min(shards, 10_000)), "shard").sortWithinPartitions("shard", "arrival").drop("arrival").write.partitionBy("shard").text(folder)
    found = validation.file_digests(validation.files_of(spark, folder, "*.txt"))
    counts = d.groupBy("shard").agg(F.count("*").alias("n_lines"))
    named = found.select(F.regexp_extract("name", r"shard=(\d+)/", 1).cast("long").alias("shard"), "bytes", "sha256")
    return named.join(counts, "shard").select("shard", "n_lines", "bytes", "sha256")


VOCABULARY = 65_000


@query(f"""WITH {FLAT}, i AS (SELECT p, {ID} AS id FROM tok) SELECT 'tokens-' || lpad((p // 100000)::VARCHAR, 6, '0') || '.bin' AS name, count(*) AS tokens, (2 * count(*))::BIGINT AS bytes, min(id)::BIGINT AS least,
  max(id)::BIGINT AS most, count(*) FILTER (id >= {VOCABULARY}) AS outside, count(*) FILTER (id >= {VOCABULARY}) > 0 AS wrong FROM i GROUP BY 1""")
def token_part_scan(spark, sf_dir):
    """V1, V2: every id of a written token binary is read by tasks; parts with ids outside of a vocabulary of 65,000 are named as wrong."""
    tokens, total = stream(spark, sf_dir)
    folder = shared_path(spark, "scanned")
    files.write_token_binary(tokens.select("start", F.transform("ids", token_id).alias("ids")), folder, total, [{"source": "documents"}], "md5", items=100_000)
    scanned = validation.scan_parts(spark, folder, VOCABULARY)
    errors = validation.token_part_errors(scanned, validation.part_table(spark, total, 100_000)).select("name").distinct().withColumn("wrong", F.lit(True))
    return scanned.join(errors, "name", "left").select("name", "tokens", "bytes", "least", "most", "outside", F.coalesce("wrong", F.lit(False)).alias("wrong"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' ELSE source END AS source, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN l.toxic ELSE n_chars END, 0)::BIGINT AS n_chars
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def stored_upsert(spark, sf_dir):
    """A stored table whose labelled rows are replaced in one commit; files without such a row are not written again."""
    folder = shared_path(spark, "stored")
    rows = in_order(spark, sf_dir, "doc_id", "source", "n_chars").select("doc_id", "source", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    commit.write(rows, folder, rows_each=1000)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = labels.join(rows.select("doc_id"), "doc_id", "left_semi")
    commit.upsert(known.select("doc_id", F.lit("labelled").alias("source"), F.coalesce("toxic", F.lit(0)).cast("long").alias("n_chars")), folder, ["doc_id"])
    return commit.read(spark, folder)


@query("""WITH r AS (SELECT event_type AS run, event_id // 2 * 2 AS step, event_id AS ord, value AS loss FROM events), l AS (SELECT run, step, arg_max(loss, ord) AS loss FROM r GROUP BY 1, 2)
SELECT run, step, loss, coalesce(loss < min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS improved FROM l""")
def arriving_logs_bests(spark, sf_dir):
    """D4, W14 over arriving files: events as validations of five runs, each step logged twice, in files that come late and twice."""
    folder = shared_path(spark, "logs")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type is not null")
    k = F.col("event_id")
    rows = e.select(F.col("event_type").alias("run"), k.alias("ord"), F.lit("validation").alias("type"), (F.floor(k / 2) * 2).alias("step"), F.col("value").alias("loss"), F.lit(True).alias("ok"))
    for turn in (1, 0, 1):  # by a hash, so steps come in any order, and half of them again
        rows.where(F.pmod(F.xxhash64("ord"), F.lit(2)) == turn).write.mode("append").json(f"{folder}/in")
        arriving_logs.follow(arriving_logs.records(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return commit.read(spark, f"{folder}/out/bests").select("run", "step", "loss", "improved")
