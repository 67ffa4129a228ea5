"""Registered queries over documents: extraction, quotas, windows, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokenize
from ..operators import packing, quota, split
from ..sources import files
from ..sources.shared import shared_path
from . import sql as S

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The table's columns, read as it lies: a table has as many splits as its files and row groups give."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text", "source")))


def fields(df: DataFrame) -> DataFrame:
    """Candidate fields as sources have them: a short text with a long content, an empty text, no text at all."""
    k = F.col("doc_id") % 4
    return df.select(
        "doc_id", F.when(k == 0, "short").when(k == 1, "").when(k == 2, F.col("text")).alias("text"), F.when(k < 2, F.col("text")).alias("content"),
        F.when(k == 3, F.col("text")).alias("article"), F.when(k == 0, F.concat(F.lit(" "), F.col("text"))).alias("body"),
    )


FIELDS = """f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'short' WHEN 1 THEN '' WHEN 2 THEN text END AS text, CASE WHEN doc_id % 4 < 2 THEN text END AS content,
  CASE WHEN doc_id % 4 = 3 THEN text END AS article, CASE WHEN doc_id % 4 = 0 THEN chr(160) || text END AS body FROM documents)"""
NAMES = ["text", "content", "article", "body"]


def _columns(names=NAMES):
    return [F.col(n) for n in names]


def _first(test: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {test.format(s=S.strip(n))} THEN {S.strip(n)} END" for n in NAMES) + ", '')"


@query(f"WITH {FIELDS}, e AS (SELECT doc_id, {_first('length({s}) >= 80')} AS text FROM f) SELECT doc_id, text FROM e WHERE length(text) >= 80")
def extract_first_long(spark, sf_dir):
    """The first field that is long enough."""
    out = T.once(fields(documents(spark, sf_dir)).select("doc_id", *NAMES), text=T.first_long(_columns())).select("doc_id", "text")
    return out.where(F.length("text") >= T.LEAST_CHARS)


@query(f"WITH {FIELDS}, e AS (SELECT doc_id, {_first(chr(123) + 's' + chr(125) + " <> ''")} AS text FROM f) SELECT doc_id, text FROM e WHERE length(text) >= 80")
def extract_first_non_blank(spark, sf_dir):
    """A short field hides a long one."""
    out = T.once(fields(documents(spark, sf_dir)), text=T.first_non_blank(_columns())).select("doc_id", "text")
    return out.where(F.length("text") >= T.LEAST_CHARS)


@query(f"WITH {FIELDS}, e AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN {S.strip('text')} ELSE {_first(chr(123) + 's' + chr(125) + " <> ''")} END AS text FROM f) SELECT doc_id, text FROM e WHERE length(text) >= 80")
def extract_named(spark, sf_dir):
    """The named field wins even when it is empty."""
    out = T.once(fields(documents(spark, sf_dir)), text=T.named_or_first(F.col("text"), _columns(NAMES[1:]))).select("doc_id", "text")
    return out.where(F.length("text") >= T.LEAST_CHARS)


@query(f"""WITH {FIELDS}, e AS (SELECT doc_id, array_to_string(list_filter([{', '.join(S.strip(n) for n in NAMES)}], lambda x: x IS NOT NULL AND x <> ''), chr(10) || chr(10)) AS t FROM f),
n AS (SELECT doc_id, left({S.collapse("translate(t, chr(0), ' ')")}, 12000) AS text FROM e) SELECT doc_id, text FROM n WHERE length(text) >= 120""")
def extract_all_joined(spark, sf_dir):
    """All fields joined, normalized, cut to 12,000 characters."""
    out = T.once(fields(documents(spark, sf_dir)), text=T.normalized(T.all_joined(_columns()), 12_000)).select("doc_id", "text")
    return out.where(F.length("text") >= 120)


@query(f"""WITH o AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN chr(160) WHEN 1 THEN text END AS text, lang, text AS raw FROM documents),
e AS (SELECT doc_id, CASE WHEN coalesce({S.strip('text')}, '') <> '' THEN {S.strip('text')} WHEN length(lang) > 200 THEN lang WHEN length(raw) > 200 THEN raw ELSE '' END AS t FROM o),
n AS (SELECT doc_id, left({S.collapse("translate(t, chr(0), ' ')")}, 12000) AS text FROM e) SELECT doc_id, text FROM n WHERE length(text) >= 120""")
def extract_other_field(spark, sf_dir):
    """Where all known fields are blank or missing, the first other field of more than 200 characters."""
    k = F.col("doc_id") % 3
    d = documents(spark, sf_dir, "doc_id", "text", "lang").select("doc_id", F.when(k == 0, "\u00a0").when(k == 1, F.col("text")).alias("text"), "lang", F.col("text").alias("raw"))
    joined = T.all_joined([F.col("text")], [F.col("lang"), F.col("raw")])
    return T.once(d, text=T.normalized(joined, 12_000)).select("doc_id", "text").where(F.length("text") >= 120)


@query(f"""WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, text FROM documents WHERE text <> '')
SELECT doc_id, sha256(replace(text, chr(10), ' ')) AS flat FROM t WHERE i <= 500""")
def tokenizer_sample(spark, sf_dir):
    """Of a tokenizer's corpus the first 500 texts, newlines as spaces; empty ones do not count."""
    d = documents(spark, sf_dir, "doc_id", "text").where("text <> ''").withColumn("one", F.lit(1).cast("long"))
    ranked = quota.running(d, "one", "doc_id", ordered=documents(spark, sf_dir, "doc_id")).where("through <= 500")
    return ranked.select("doc_id", F.sha2(T.one_line(F.col("text")), 256).alias("flat"))


@query("SELECT doc_id, sha256(text || chr(10)) AS line, sha256(replace(text, chr(10), ' ')) AS flat FROM documents")
def corpus_lines(spark, sf_dir):
    """Lines of tokenizer corpora (the fixtures hold no NUL)."""
    d = documents(spark, sf_dir, "doc_id", "text")
    return d.select("doc_id", F.sha2(T.corpus_line(F.col("text")), 256).alias("line"), F.sha2(T.one_line(F.col("text")), 256).alias("flat"))


# ---- quotas: white-space tokens, two of them for the markers; half of each source's tokens, what is over to the last ----
def counted(spark, sf_dir) -> DataFrame:
    """Documents of at least 80 characters with their white-space tokens between two markers."""
    d = T.once(documents(spark, sf_dir), text=T.strip(F.col("text"))).where(F.length("text") >= T.LEAST_CHARS)
    ids = F.concat(F.array(F.lit("<s>")), T.words(F.col("text")), F.array(F.lit("</s>")))
    return T.once(d, ids=ids).select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n"))


def quota_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = counted(spark, sf_dir)
    table = quota.share_table(rows)
    return quota.running(quota.with_quota(rows, table), "n", "doc_id", "source", documents(spark, sf_dir, "doc_id")), table


SHARES = """q AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS place,
  (s // 2 + CASE WHEN row_number() OVER (ORDER BY source {order}) = 1 THEN sum(s) OVER () // 2 - sum(s // 2) OVER () ELSE 0 END)::BIGINT AS quota FROM t)"""
COUNTED = f"""d AS (SELECT doc_id, source, {S.strip('text')} AS text FROM documents),
c AS (SELECT doc_id, source, ['<s>'] || {S.words('text')} || ['</s>'] AS ids FROM d WHERE length(text) >= 80),
t AS (SELECT source, sum(len(ids))::BIGINT AS s FROM c WHERE source IS NOT NULL GROUP BY 1), {SHARES.format(order='DESC')},
r AS (SELECT c.*, place, quota, len(ids)::BIGINT AS n, sum(len(ids)) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS through FROM c JOIN q USING (source)),
cut AS (SELECT *, least(n, quota - (through - n)) AS taken FROM r WHERE through - n < quota)"""


@query(f"""WITH {COUNTED} SELECT source, place::INT AS place, quota, count(*) AS n_docs, sum(taken)::BIGINT AS tokens, max(doc_id) AS last_doc,
  arg_max(taken, doc_id)::BIGINT AS last_taken, arg_max(array_to_string(ids[1:taken::INT], ' '), doc_id) AS last_text FROM cut GROUP BY ALL""")
def quota_mix(spark, sf_dir):
    """Documents cut to exact token quotas by source; a source that cannot fill its quota is an error."""
    rows, _ = quota_rows(spark, sf_dir)
    last = F.max_by(F.struct("taken", "ids"), "doc_id")
    cut = quota.exact_cut(rows, items="ids").groupBy("source", "place", "quota")
    made = cut.agg(F.count("*").alias("n_docs"), F.sum("taken").alias("tokens"), F.max("doc_id").alias("last_doc"), last.alias("last"))
    full = F.when(F.col("tokens") == F.col("quota"), F.col("tokens")).otherwise(F.raise_error(F.concat(F.lit("exhausted before its quota: "), "source")))
    return made.select("source", "place", "quota", "n_docs", full.alias("tokens"), "last_doc", F.col("last.taken").alias("last_taken"), F.array_join("last.ids", " ").alias("last_text"))


@query(f"""WITH c AS (SELECT doc_id, source, len({S.words('text')})::BIGINT AS n FROM documents WHERE length({S.strip('text')}) >= 80),
k AS (SELECT * FROM c WHERE n >= 32), t AS (SELECT source, sum(n)::BIGINT AS s FROM k WHERE source IS NOT NULL GROUP BY 1), {SHARES.format(order='ASC')},
r AS (SELECT k.*, quota, sum(n) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS through FROM k JOIN q USING (source))
SELECT source, quota, count(*) AS n_docs, sum(n)::BIGINT AS tokens FROM r WHERE through - n < quota OR through = n GROUP BY ALL""")
def quota_overshoot(spark, sf_dir):
    """Whole documents of at least 32 tokens (without markers) until the quota is reached; shorter ones do not count."""
    d = documents(spark, sf_dir).where(F.length(T.strip(F.col("text"))) >= T.LEAST_CHARS)
    rows = T.once(d, n=F.size(T.words(F.col("text"))).cast("long")).select("doc_id", "source", "n").where("n >= 32")
    table = quota.share_table(rows, rest_to="first")
    cut = quota.overshoot_cut(quota.running(quota.with_quota(rows, table), "n", "doc_id", "source", documents(spark, sf_dir, "doc_id")))
    return cut.groupBy("source", "quota").agg(F.count("*").alias("n_docs"), F.sum("taken").alias("tokens"))


@query(f"""WITH {COUNTED} SELECT source, (s + place % 3)::BIGINT AS quota, s AS available FROM q JOIN t USING (source) WHERE place % 3 > 0""")
def quota_short_sources(spark, sf_dir):
    """Sources too small for their quota; two of three have one or two tokens less than is asked of them."""
    rows = counted(spark, sf_dir).drop("ids")
    table = quota.share_table(rows, part=1).withColumn("quota", F.col("quota") + F.col("place") % 3)
    return quota.short_sources(rows, table)


STARTS = "st AS (SELECT source, coalesce(sum(quota) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS source_start FROM q)"


@query(f"WITH {COUNTED}, {STARTS} SELECT doc_id, cut.source, (source_start + through - n)::BIGINT AS start, taken::BIGINT AS taken FROM cut JOIN st USING (source)")
def stream_offsets(spark, sf_dir):
    """Each document's place in the stream of all sources."""
    rows, table = quota_rows(spark, sf_dir)
    return quota.offsets(quota.exact_cut(rows.drop("ids")), table).select("doc_id", "source", "start", "taken")


@query(f"""WITH {COUNTED} SELECT doc_id, source, greatest(500 - (through - n), 0)::BIGINT AS first, (taken - greatest(500 - (through - n), 0))::BIGINT AS taken,
  array_to_string(ids[greatest(500 - (through - n), 0)::INT + 1 : taken::INT], ' ') AS text FROM cut WHERE through > 500 AND taken > greatest(500 - (through - n), 0)""")
def resume_skip(spark, sf_dir):
    """What is left after the first 500 tokens of each source."""
    rows, _ = quota_rows(spark, sf_dir)
    return quota.exact_cut(rows, items="ids", skip=500).select("doc_id", "source", "first", "taken", F.array_join("ids", " ").alias("text"))


@query(f"""WITH d AS (SELECT doc_id, source, text || chr(10) AS text, strlen(text) + 1 AS n FROM documents), t AS (SELECT source, sum(n)::BIGINT AS s FROM d WHERE source IS NOT NULL GROUP BY 1), {SHARES.format(order='DESC')},
r AS (SELECT d.*, quota, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS through FROM d JOIN q USING (source)),
k AS (SELECT *, quota - (through - n) AS room FROM r WHERE through - n < quota),
b AS (SELECT *, CASE WHEN n <= room THEN text ELSE list_reduce(list_filter(list_transform(range(greatest(room - 3, 0)::BIGINT // 4, room::BIGINT + 1), lambda i: left(text, i::INT)), lambda p: strlen(p) <= room), lambda a, p: CASE WHEN strlen(p) > strlen(a) THEN p ELSE a END) END AS cut FROM k)
SELECT doc_id, source, quota, strlen(cut)::BIGINT AS n_bytes, sha256(cut) AS sha FROM b""")
def byte_quota(spark, sf_dir):
    """A tokenizer corpus cut to UTF-8 byte quotas at whole characters, line by line."""
    lines = documents(spark, sf_dir).select("doc_id", "source", T.corpus_line(F.col("text")).alias("text")).withColumn("n", F.octet_length("text").cast("long"))
    table = quota.share_table(lines)
    cut = quota.byte_cut(quota.running(quota.with_quota(lines, table), "n", "doc_id", "source", lines))
    return cut.select("doc_id", "source", "quota", F.col("taken").alias("n_bytes"), F.sha2("text", 256).alias("sha"))


@query(f"""WITH d AS (SELECT doc_id, len({S.words('text')})::BIGINT AS n FROM documents), r AS (SELECT *, sum(n) OVER (ORDER BY doc_id) AS through, sum(n) OVER () // 2 AS half FROM d)
SELECT doc_id, least(n, half - (through - n))::BIGINT AS taken FROM r WHERE through - n < half AND n > 0""")
def single_pool(spark, sf_dir):
    """One pool cut to half of all tokens, whatever the sources."""
    d = T.once(documents(spark, sf_dir, "doc_id", "text"), n=F.size(T.words(F.col("text"))).cast("long")).select("doc_id", "n")
    half = d.agg(F.floor(F.sum("n") / 2)).first()[0] or 0
    return quota.exact_cut(quota.running(d, "n", "doc_id", ordered=documents(spark, sf_dir, "doc_id")).withColumn("quota", F.lit(half))).select("doc_id", "taken")


@query("SELECT source, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars, count(*) FILTER (text <> '') AS n_not_empty FROM documents GROUP BY ROLLUP (source)")
def source_totals(spark, sf_dir):
    """A1, A2, A3: totals by source and over all (source is null)."""
    d = documents(spark, sf_dir, "source", "text")
    return d.rollup("source").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"), F.count(F.when(F.col("text") != "", 1)).alias("n_not_empty"))


# ---- windows ----
def stream(spark, sf_dir) -> tuple[DataFrame, int]:
    """The stream's pieces, and how many tokens it has."""
    rows, table = quota_rows(spark, sf_dir)
    return quota.offsets(quota.exact_cut(rows, items="ids"), table).select("start", "ids"), table.agg(F.sum("quota")).first()[0] or 0


FLAT = f"{COUNTED}, {STARTS}, s AS (SELECT (source_start + through - n)::BIGINT AS start, ids[1:taken::INT] AS ids FROM cut JOIN st USING (source)), tok AS (SELECT start + i - 1 AS p, ids[i] AS t FROM s, unnest(range(1, len(ids) + 1)) AS u(i))"


ID = "('0x' || substr(md5(t), 1, 4))::BIGINT"


def token_id(token):
    """16 bits of a token's MD5."""
    return F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("int")


@query(f"""WITH {FLAT} SELECT (p // 100000)::INT AS part, count(*) AS n_tokens, min(p)::BIGINT AS first, sum({ID})::BIGINT AS total, sum({ID} * (p % 1009))::BIGINT AS placed FROM tok GROUP BY 1""")
def token_binary_parts(spark, sf_dir):
    """The stream written as 16-bit parts of 100,000 tokens and read back; a token's id is 16 bits of its MD5."""
    tokens, total = stream(spark, sf_dir)
    folder = shared_path(spark, "tokens")
    files.write_token_binary(tokens.select("start", F.transform("ids", token_id).alias("ids")), folder, total, [{"source": "documents"}], "md5", items=100_000)
    read = files.token_binary(spark, folder).select(F.regexp_extract("name", r"(\d+)\.bin", 1).cast("int").alias("part"), "start", F.posexplode("ids").alias("i", "id"))
    place = F.col("part").cast("long") * 100_000 + F.col("start") + F.col("i")
    return read.groupBy("part").agg(F.count("*").alias("n_tokens"), F.min(place).alias("first"), F.sum("id").alias("total"), F.sum(F.col("id") * (place % 1009)).alias("placed"))


@query(f"WITH {FLAT} SELECT p // 256 AS \"window\", array_to_string(list(t ORDER BY p), ' ') AS tokens FROM tok GROUP BY 1 HAVING count(*) = 256")
def windows(spark, sf_dir):
    """Windows of 256 tokens; the short tail goes."""
    return packing.windows(stream(spark, sf_dir)[0], 256).select("window", F.array_join("tokens", " ").alias("tokens"))


@query(f"""WITH {FLAT}, w AS (SELECT k AS "window", t, p FROM tok, unnest([p // 256, p // 256 - 1]) AS u(k) WHERE k >= 0 AND p - k * 256 <= 256),
g AS (SELECT "window", list(t ORDER BY p) AS l FROM w GROUP BY 1 HAVING count(*) = 257)
SELECT "window", array_to_string(l[1:256], ' ') AS inputs, array_to_string(l[2:257], ' ') AS labels FROM g WHERE "window" < (SELECT count(*) FROM tok) // 256 - 1""")
def windows_shifted(spark, sf_dir):
    """Inputs and next-token labels; of N tokens N // 256 - 1 windows."""
    tokens, total = stream(spark, sf_dir)
    made = packing.shifted(packing.windows(tokens, 256, extra=1), 256, total)
    return made.select("window", F.array_join("inputs", " ").alias("inputs"), F.array_join("labels", " ").alias("labels"))


@query(f"""WITH w AS (SELECT doc_id, {S.words('text')} AS w FROM documents), b AS (SELECT doc_id, ['<s>'] || w[1:62] || ['</s>'] AS b FROM w)
SELECT doc_id, array_to_string(b || list_transform(range(64 - len(b)), lambda i: '<pad>'), ' ') AS tokens FROM b""")
def one_window_each(spark, sf_dir):
    """One window for each document, padded."""
    d = documents(spark, sf_dir, "doc_id", "text")
    made = packing.one_each(T.words(F.col("text")), 64, F.lit("<s>"), F.lit("</s>"), F.lit("<pad>"))
    return d.select("doc_id", F.array_join(made, " ").alias("tokens"))


@query(f"""WITH w AS (SELECT doc_id, {S.words('text')} AS w FROM documents)
SELECT doc_id, k AS seg, array_to_string(w[k * 127 + 1 : k * 127 + 127], ' ') AS tokens FROM w, unnest(range((len(w) + 126) // 127)) AS u(k)""")
def segments(spark, sf_dir):
    """Runs of 127 tokens, the short last one too."""
    d = T.once(documents(spark, sf_dir, "doc_id", "text"), ids=T.words(F.col("text"))).select("doc_id", "ids")
    return packing.segments(d, 128).select("doc_id", F.col("seg").cast("long").alias("seg"), F.array_join("tokens", " ").alias("tokens"))


@query("SELECT doc_id, doc_id // 32 AS batch FROM documents WHERE doc_id // 32 < (SELECT count(*) FROM documents) // 32")
def full_batches(spark, sf_dir):
    """Batches of 32; the short last one goes."""
    d = documents(spark, sf_dir, "doc_id")
    return packing.batches(d, "doc_id", 32, d.count())


# ---- samples, holdouts, permutations ----
# A window is a document here: a fiftieth of the table is held out.
N = "(SELECT count(*) AS size, count(*) // 50 AS held FROM documents)"
HELD = f"SELECT ((2 * i + 1) * size) // (2 * held) AS w FROM {N} n, range(10000) t(i) WHERE i < held"


def sizes(spark, sf_dir) -> tuple[int, int]:
    n = documents(spark, sf_dir, "doc_id").count()
    return n, n // 50


@query(f'SELECT w AS "window" FROM ({HELD})')
def holdout_windows(spark, sf_dir):
    """Held-out windows at the middles of equal parts."""
    return split.midpoints(spark, *sizes(spark, sf_dir))


@query(f"""WITH h AS ({HELD}), p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
SELECT i AS "window", row_number() OVER (ORDER BY i) - 1 AS place FROM p WHERE i NOT IN (SELECT w FROM h)""")
def training_windows(spark, sf_dir):
    """The other windows, numbered anew."""
    return split.without_holdout(spark, *sizes(spark, sf_dir))


#: The permutations of tables of these sizes, which the SQL cannot draw.
DRAWN = ", ".join(f"({n}, {a}, {b})" for n in (200, 1_000, 10_000) for a, b in [split.permutation(n, 7, 1)])


@query(f"""WITH p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS size FROM documents)
SELECT i AS place, (a::BIGINT * i + b) % p.size AS item FROM p JOIN (VALUES {DRAWN}) AS t(size, a, b) ON p.size = t.size WHERE i >= 100""")
def permutation_from(spark, sf_dir):
    """An affine permutation of the table's places, from place 100 on."""
    n = documents(spark, sf_dir, "doc_id").count()
    return split.permuted(spark, n, *split.permutation(n, 7, 1), 100)


#: The sample's places in tables of these sizes: what the SQL, which cannot draw it, is given.
PLACES = ", ".join(f"({n}, {i + 1})" for n in (200, 1_000, 10_000) for i in split.subset(n, 50, 2026, "piqa"))


@query(f"""WITH p AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS place, count(*) OVER () AS size FROM documents)
SELECT doc_id, source FROM p SEMI JOIN (SELECT * FROM (VALUES {PLACES}) AS t(size, place)) c ON p.size = c.size AND p.place = c.place""")
def seeded_subset(spark, sf_dir):
    """The sample is drawn over the table's counted rows and taken by their places in order of doc_id."""
    d = documents(spark, sf_dir, "doc_id", "source")
    chosen = spark.createDataFrame([(i + 1,) for i in split.subset(d.count(), 50, 2026, "piqa")], "through long")
    placed = quota.running(d.withColumn("one", F.lit(1).cast("long")), "one", "doc_id")
    return placed.join(F.broadcast(chosen), "through", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def first_rows(spark, sf_dir):
    """T4: the first 100 rows in arrival order."""
    return documents(spark, sf_dir, "doc_id", "source").orderBy("doc_id").limit(100)


@query("SELECT doc_id, source FROM documents")
def shuffled_documents(spark, sf_dir):
    """All rows in a seeded order (compared as a set)."""
    return split.shuffled(documents(spark, sf_dir, "doc_id", "source"), "doc_id", 5)


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank_in_source, count(*) OVER () AS slots FROM documents")
def riffle_merge(spark, sf_dir):
    """A random interleaving in which each source keeps its order; slots are 0 to n - 1."""
    d = documents(spark, sf_dir, "doc_id", "source").withColumn("ord", F.col("doc_id"))
    slots = split.riffled(d, 3).select("source", "doc_id", "slot", F.lit(1).cast("long").alias("one"))
    ranked = quota.running(slots, "one", "slot", "source")  # a source's rank by slot is its rank by doc_id if its order is kept
    n = slots.agg((F.max("slot") + 1).alias("slots"), F.count_distinct("slot").alias("k")).first()
    return ranked.select("source", "doc_id", F.col("through").alias("rank_in_source"), F.lit(n["slots"] if n["slots"] == n["k"] else -1).cast("long").alias("slots"))


def weighted(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir, "doc_id").select("doc_id", (1.0 / (1 + F.col("doc_id") % 7)).alias("w"))


@query("""WITH w AS (SELECT doc_id, 420 // (1 + doc_id % 7) AS w FROM documents),
c AS (SELECT *, sum(w) OVER () AS total, coalesce(sum(w) OVER (ORDER BY w DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT doc_id, round(w::DOUBLE / total::DOUBLE, 12) AS p FROM c WHERE 10 * before <= 9 * total""")
def nucleus(spark, sf_dir):
    """Of all documents, the likeliest up to a mass of 0.9, with the one that passes it. The SQL has whole numbers, so a
    place whose mass before is 0.9 to the last bit could differ; shares are rounded to 12 places."""
    return split.nucleus(weighted(spark, sf_dir), "w", "doc_id", 0.9).select("doc_id", F.round("p", 12).alias("p"))


@query(None)
def bpe_round_trip(spark, sf_dir):
    """Ids of a tokenizer file with markers, checked to fit 16 bits, and the text they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    d = documents(spark, sf_dir, "doc_id", "text").withColumn("ids", tokenize.bpe(path)("text"))
    whole = d.withColumn("wrapped", tokenize.fits_16_bits(tokenize.wrapped(F.col("ids"), 50256, 50256)))
    return whole.select("doc_id", F.size("wrapped").alias("n"), (tokenize.bpe_text(path)("ids") == F.col("text")).alias("same"))
