"""Registered queries over conversations: sources, targets, dedup, decontamination, splits, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chat, tokenize
from ..functions import text as T
from ..operators import dedup, packing, split
from ..sources import chats
from ..sources.shared import stored
from . import sql as S

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


MESSAGE = "array<struct<role: string, content: string>>"
def odd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as sources have them: roles in other words and cases, tool messages, blank contents, one message alone.

    A message's place and its conversation's number say which of these it gets.
    """
    c = conversations(spark, sf_dir)

    def odd(m, i):
        k = F.col("conv_id") + i
        other = F.when(m["role"] == "user", F.when(k % 3 == 0, "Human").when(k % 3 == 1, "prompter").otherwise("human")).when(m["role"] == "assistant", F.when(k % 3 == 0, " BOT ").when(k % 3 == 1, "gpt").otherwise("bot")).otherwise(m["role"])
        role = F.when(k % 13 == 7, "tool").when(k % 5 < 3, m["role"]).otherwise(other)
        return F.struct(role.alias("role"), F.when(k % 11 == 3, "  ").otherwise(F.concat(F.lit(" "), m["content"])).alias("content"))

    whole = F.transform("conversation", odd)
    return c.select(F.col("conv_id").cast("int").alias("ord"), F.when(F.col("conv_id") % 10 == 9, F.slice(whole, 1, 1)).otherwise(whole).cast(MESSAGE).alias("messages"))


_K = "(conv_id + i - 1)"
ODD_SQL = f"""{S.CONVERSATIONS}, o AS (SELECT conv_id, list_transform(conversation, lambda m, i: struct_pack(role := CASE WHEN {_K} % 13 = 7 THEN 'tool' WHEN {_K} % 5 < 3 THEN m.role
  WHEN m.role = 'user' THEN CASE {_K} % 3 WHEN 0 THEN 'Human' WHEN 1 THEN 'prompter' ELSE 'human' END WHEN m.role = 'assistant' THEN CASE {_K} % 3 WHEN 0 THEN ' BOT ' WHEN 1 THEN 'gpt' ELSE 'bot' END ELSE m.role END,
  content := CASE WHEN {_K} % 11 = 3 THEN '  ' ELSE ' ' || m.content END)) AS c FROM conv),
h AS (SELECT conv_id::INT AS ord, CASE WHEN conv_id % 10 = 9 THEN c[1:1] ELSE c END AS messages FROM o)"""
SHOWN = "to_json(list_transform({c}, lambda m: struct_pack(role := m.role, content := m.content)))::VARCHAR"


def shown(c: str):
    return F.to_json(c).alias("conversation")


def _both(c: str) -> str:
    has = "len(list_filter({c}, lambda m: m.role = '{r}' AND {s} <> '')) > 0"
    return " AND ".join(has.format(c=c, r=r, s=S.strip("m.content")) for r in ("user", "assistant"))


@query(f"WITH {ODD_SQL}, k AS (SELECT ord, {S.canonical('messages')} AS c FROM h) SELECT ord, {SHOWN.format(c='c')} AS conversation, {_both('c')} AS valid FROM k")
def chat_canonical(spark, sf_dir):
    """Canonical roles, stripped contents, no blank messages."""
    out = odd_rows(spark, sf_dir).select("ord", chat.canonical(F.col("messages")).alias("c"))
    return out.select("ord", shown("c"), chat.valid(F.col("c")).alias("valid"))


@query(f"WITH {ODD_SQL}, k AS (SELECT ord, list_filter({S.canonical('messages')}, lambda m: m.role IN ('user', 'assistant', 'system')) AS c FROM h WHERE ord < 50) SELECT ord, {SHOWN.format(c='c')} AS conversation FROM k WHERE {_both('c')}")
def chat_broad_source(spark, sf_dir):
    """The limit counts rows before they are checked."""
    out = chats.broad_source(odd_rows(spark, sf_dir), limit=50)
    return out.select("ord", shown("conversation"))


@query(f"WITH {ODD_SQL}, k AS (SELECT ord, {S.canonical('messages', exact=True)} AS c FROM h) SELECT ord, {SHOWN.format(c='c')} AS conversation FROM k")
def chat_source(spark, sf_dir):
    """Roles as they are written."""
    return chats.conversation_source(odd_rows(spark, sf_dir)).select("ord", shown("conversation"))


@query(f"""WITH {ODD_SQL}, k AS (SELECT ord, list_filter(messages, lambda m: m.role IN ('user', 'assistant')) AS c FROM h),
l AS (SELECT ord, c[1:8] AS c FROM k WHERE len(c) >= 2 ORDER BY ord LIMIT 20), w AS (SELECT ord, list_filter(c, lambda m: {S.strip('m.content')} <> '') AS c FROM l)
SELECT ord, {SHOWN.format(c='c')} AS conversation FROM w WHERE len(c) >= 2 AND len(list_filter(c, lambda m: m.role = 'assistant')) > 0""")
def chat_short_source(spark, sf_dir):
    """The limit counts accepted rows before the last check."""
    return chats.short_source(odd_rows(spark, sf_dir), 20).select("ord", shown("conversation"))


@query(f"""WITH t AS (SELECT conv_id::INT AS ord, max(text) FILTER (turn = 0) AS q, max(text) FILTER (turn = 1) AS r, max(text) FILTER (turn = 2) AS x FROM conversations GROUP BY 1),
p AS (SELECT ord, CASE WHEN ord % 7 = 3 THEN '  ' ELSE ' ' || q || ' ' END AS instruction, CASE WHEN ord % 5 = 1 THEN ' ' ELSE x END AS context, CASE WHEN ord % 9 = 4 THEN chr(9) ELSE r || ' ' END AS response FROM t WHERE q IS NOT NULL AND r IS NOT NULL)
SELECT ord, {SHOWN.format(c="[struct_pack(role := 'user', content := u), struct_pack(role := 'assistant', content := a)]")} AS conversation
FROM (SELECT ord, {S.strip("instruction || CASE WHEN coalesce(" + S.strip('context') + ", '') = '' THEN '' ELSE chr(10) || chr(10) || 'Context:' || chr(10) || context END")} AS u, {S.strip('response')} AS a
  FROM p WHERE {S.strip('instruction')} <> '' AND {S.strip('response')} <> '')""")
def instruction_source(spark, sf_dir):
    """Instructions with a titled context; the first three turns of each conversation, some of them blank."""
    turn = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy(F.col("conv_id").cast("int").alias("ord")).agg(turn(0).alias("q"), turn(1).alias("r"), turn(2).alias("x"))
    k, sp = F.col("ord"), F.lit(" ")
    rows = t.where("q is not null and r is not null").select(
        "ord", F.when(k % 7 == 3, "  ").otherwise(F.concat(sp, "q", sp)).alias("instruction"), F.when(k % 5 == 1, " ").otherwise(F.col("x")).alias("context"), F.when(k % 9 == 4, "\t").otherwise(F.concat("r", sp)).alias("response")
    )
    return chats.instruction_source(rows, "Context").select("ord", shown("conversation"))


AS_PAIR = SHOWN.format(c="[struct_pack(role := 'user', content := u), struct_pack(role := 'assistant', content := a)]")


@query(f"""WITH b AS (SELECT item_id::INT AS ord, {S.words('text')} AS w FROM benchmark),
c AS (SELECT ord, ' ' || array_to_string(w[1:5], ' ') || '? ' AS question, [w[6] || ' ', w[7], w[8]] AS choices, CASE WHEN ord % 2 = 0 THEN ['A', 'B', 'C'] ELSE ['1', '2', '3'] END AS labels, CASE WHEN ord % 2 = 0 THEN ' b' ELSE (ord % 3 + 1)::VARCHAR END AS answer FROM b WHERE len(w) >= 8),
p AS (SELECT *, list_position(list_transform(labels, lambda x: upper(trim(x))), upper(trim(answer))) AS i FROM c),
e AS (SELECT ord, {S.strip("'Choose the correct answer and explain briefly.' || chr(10) || 'Question: ' || question || chr(10) || array_to_string(list_transform(list_zip(labels, choices), lambda x: x[1] || '. ' || x[2]), chr(10))")} AS u,
  {S.strip("'The correct answer is ' || labels[i] || ': ' || choices[i] || '.'")} AS a FROM p)
SELECT ord, {AS_PAIR} AS conversation FROM e""")
def choice_source(spark, sf_dir):
    """Choices under the source's labels and an answer in words; each text of the benchmark gives a question and three words to choose from."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("int").alias("ord"), "text")
    w = T.once(b, w=T.words(F.col("text"))).where(F.size("w") >= 8)
    even, word = F.col("ord") % 2 == 0, lambda i: F.element_at("w", i)
    texts = lambda *xs: F.array(*map(F.lit, xs))
    rows = w.select(
        "ord", F.concat(F.lit(" "), F.array_join(F.slice("w", 1, 5), " "), F.lit("? ")).alias("question"), F.array(F.concat(word(6), F.lit(" ")), word(7), word(8)).alias("choices"),
        F.when(even, texts("A", "B", "C")).otherwise(texts("1", "2", "3")).alias("labels"), F.when(even, " b").otherwise((F.col("ord") % 3 + 1).cast("string")).alias("answer"),
    )
    return chats.choice_source(rows).select("ord", shown("conversation"))


@query(f"""WITH e AS (SELECT item_id AS ord, {S.strip("'Read the passage and answer Yes or No.' || chr(10) || 'Passage: ' || text || chr(10) || 'Question: is it item ' || item_id || '?'")} AS u,
  CASE WHEN item_id % 2 = 0 THEN 'Yes.' ELSE 'No.' END AS a FROM benchmark) SELECT ord, {AS_PAIR} AS conversation FROM e""")
def reading_source(spark, sf_dir):
    """A passage and a question answered by Yes or No; each text of the benchmark as a passage."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = b.select(F.col("item_id").alias("ord"), F.col("text").alias("passage"), F.concat(F.lit("is it item "), F.col("item_id").cast("string")).alias("question"), (F.col("item_id") % 2 == 0).alias("answer"))
    return chats.reading_source(rows).select("ord", shown("conversation"))


@query(f"""WITH t AS (SELECT conv_id AS ord, {S.strip("max(CASE WHEN turn = 0 THEN text END)")} AS u, {S.strip("max(CASE WHEN turn = 1 THEN text END)")} AS a FROM conversations GROUP BY 1)
SELECT ord, {AS_PAIR} AS conversation FROM t WHERE u IS NOT NULL AND a IS NOT NULL""")
def problem_source(spark, sf_dir):
    """Problems and solutions as pairs; the first two turns of each conversation stand for them."""
    turn = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy(F.col("conv_id").alias("ord")).agg(turn(0).alias("problem"), turn(1).alias("solution"))
    return chats.problem_source(rows.where("problem is not null and solution is not null")).select("ord", shown("conversation"))


def unasked(spark, sf_dir, pairs: DataFrame) -> DataFrame:
    """The pairs whose question no user message of the conversations is, but for case."""
    asked = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user' and text is not null").select(F.lower("text").alias("__asked")).distinct()
    return pairs.join(asked, F.lower("user") == F.col("__asked"), "left_anti")


REPAIR = [(g, chats.GREETED) for g in chats.GREETINGS] + chats.OTHERS


@query(f"""WITH s AS (SELECT 'what is ' || a || '+' || b AS "user", a || '+' || b || ' is ' || (a + b) || '.' AS assistant FROM range(31) x(a), range(31) y(b)
UNION ALL SELECT 'what is ' || a || '-' || b, a || '-' || b || ' is ' || (a - b) || '.' FROM range(31) x(a), range(31) y(b) WHERE a >= b
UNION ALL SELECT * FROM {S.values(REPAIR, 'u, a')}
UNION ALL SELECT 'what is the capital of ' || k || '?', 'The capital of ' || country || ' is ' || capital || '.' FROM {S.values([(k, *v) for k, v in chats.CAPITALS.items()], 'k, country, capital')}
UNION ALL SELECT replace(p, '@', k), v FROM {S.values(list(chats.CONCEPTS.items()), 'k, v')}, (VALUES ('what is a @'), ('What is a @?'), ('Explain what a @ is.')) AS w(p))
SELECT "user", assistant, r::INT AS repeat FROM s, range(2) t(r) WHERE lower("user") NOT IN (SELECT lower(text) FROM conversations WHERE role = 'user' AND text IS NOT NULL)""")
def repair_table(spark, sf_dir):
    """Fixed pairs, sums and differences, capitals and concepts, repeated; those that the conversations ask already stay out."""
    return unasked(spark, sf_dir, chats.repair(spark, 2))


FIXED = S.values([("polish", *p) for p in chats.POLISH] + [("targeted", *p) for p in chats.TARGETED], "kind, u, a")


@query(f"""SELECT kind, u AS "user", a AS assistant, r::INT AS repeat FROM {FIXED} p, range(3) t(r) WHERE lower(u) NOT IN (SELECT lower(text) FROM conversations WHERE role = 'user' AND text IS NOT NULL)""")
def fixed_tables(spark, sf_dir):
    """The pairs of the polishing and the targeted set, three times; those that the conversations ask already stay out."""
    sets = split.concatenated([("polish", chats.pairs(spark, chats.POLISH, 3)), ("targeted", chats.pairs(spark, chats.TARGETED, 3))])
    return unasked(spark, sf_dir, sets.select(F.col("source").alias("kind"), "user", "assistant", "repeat"))


@query(None)
def logic_table(spark, sf_dir):
    """Generated questions with operands from a hash, and fixed pairs; those that the conversations ask already stay out."""
    return unasked(spark, sf_dir, chats.logic(spark, 40))


# ---- targets ----
def sourced(spark, sf_dir) -> DataFrame:
    """Two sources that share conversations: all of them, and the even ones with other white space and new answers in some."""
    c = conversations(spark, sf_dir).select(F.col("conv_id").alias("ord"), chat.canonical(F.col("conversation")).alias("conversation"))
    second = c.where("ord % 2 = 0").withColumn("conversation", F.transform("conversation", lambda m: chat.message(m["role"], F.replace(m["content"], F.lit(" "), F.lit("  ")))))
    return split.concatenated([("first", c), ("second", second)]).where(chat.valid(F.col("conversation")))


def _target_rows(base: str) -> str:
    return f"""t AS (SELECT source, place, ord, (i - 1)::INT AS target_index, c[1:i] AS prefix FROM {base}, unnest(range(1, len(c) + 1)) AS u(i) WHERE c[i].role = 'assistant' AND {S.strip('c[i].content')} <> ''),
e AS (SELECT *, {S.identity('prefix')} AS id FROM t)"""


SOURCED = f"""{S.CONVERSATIONS}, k AS (SELECT conv_id AS ord, {S.canonical('conversation')} AS c FROM conv),
b AS (SELECT 'first' AS source, 0 AS place, ord, c FROM k UNION ALL SELECT 'second', 1, ord, list_transform(c, lambda m: struct_pack(role := m.role, content := replace(m.content, ' ', '  '))) FROM k WHERE ord % 2 = 0),
v AS (SELECT * FROM b WHERE {_both('c')}), {_target_rows('v')}"""


def targets(spark, sf_dir) -> DataFrame:
    return dedup.targets(sourced(spark, sf_dir))


@query(f"WITH {SOURCED} SELECT source, place, ord, target_index, len(prefix)::INT AS n, id FROM e")
def target_expansion(spark, sf_dir):
    """One record for each assistant message."""
    return targets(spark, sf_dir).select("source", "place", "ord", "target_index", F.size("prefix").alias("n"), "id")


@query(f"WITH {SOURCED} SELECT source, place, ord, target_index, id FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, ord, target_index) = 1")
def target_dedup(spark, sf_dir):
    """Of equal prefixes the first over all sources stays."""
    return dedup.first_of(targets(spark, sf_dir).select("source", "place", "ord", "target_index", "id"), "id", ["place", "ord", "target_index"])


@query(f"""WITH {SOURCED}, j AS (SELECT source, place, ord, to_json(list_transform(c, lambda m: struct_pack(content := {S.strip('m.content')}, role := m.role)))::VARCHAR AS js FROM v)
SELECT source, place, ord, sha256(js) AS id FROM j QUALIFY row_number() OVER (PARTITION BY js ORDER BY place, ord) = 1""")
def conversation_dedup(spark, sf_dir):
    """Whole conversations, stripped but not collapsed."""
    rows = sourced(spark, sf_dir).select("source", "place", "ord", F.sha2(chat.canonical_json(F.col("conversation"), collapsed=False), 256).alias("id"))
    return dedup.first_of(rows, "id", ["place", "ord"])


def blocked(spark, sf_dir) -> DataFrame:
    """Benchmark texts, and the user texts of every fifth conversation so that some targets are blocked."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    users = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user' and conv_id % 5 = 0")
    return dedup.blocked([(items, "text"), (users, "text")])


BLOCKED = f"blocked AS (SELECT DISTINCT unnest({S.grams('text')}) AS gram FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations WHERE role = 'user' AND conv_id % 5 = 0))"
USERS = "array_to_string(list_transform(list_filter(prefix, lambda m: m.role = 'user'), lambda m: m.content), chr(10))"
FLAGGED = f"""g AS (SELECT source, ord, target_index, unnest({S.grams(USERS)}) AS gram FROM e), bad AS (SELECT DISTINCT source, ord, target_index FROM g SEMI JOIN blocked USING (gram)),
fl AS (SELECT e.*, bad.source IS NOT NULL AS blocked FROM e LEFT JOIN bad USING (source, ord, target_index)),
ok AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place, ord, target_index) AS k FROM fl WHERE NOT blocked)"""


def flagged(spark, sf_dir) -> DataFrame:
    """Targets with their user texts and ids are written once, as are the blocked n-grams: both are needed several times."""
    t = stored(targets(spark, sf_dir).select("source", "place", "ord", "target_index", "id", dedup.user_text(F.col("prefix")).alias("asked")), "targets")
    return dedup.flagged(t, ["source", "ord", "target_index"], F.col("asked"), stored(blocked(spark, sf_dir), "blocked")).drop("asked")


@query(f"WITH {BLOCKED} SELECT gram FROM blocked")
def blocked_grams(spark, sf_dir):
    """The distinct n-grams of the blocked texts."""
    return blocked(spark, sf_dir)


@query(f"""WITH b AS (SELECT DISTINCT unnest({S.grams('text')}) AS gram FROM benchmark), g AS (SELECT doc_id, unnest({S.grams('text')}) AS gram FROM documents)
SELECT DISTINCT doc_id FROM g SEMI JOIN b USING (gram)""")
def contaminated_documents(spark, sf_dir):
    """J1 over documents: those that share a 13-gram with the benchmark."""
    grams_of = dedup.blocked([(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "text")])
    return dedup.contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], F.col("text"), grams_of)


@query(f"WITH {SOURCED}, {BLOCKED}, {FLAGGED} SELECT source, place, ord, target_index, id FROM ok WHERE k = 1")
def clean_targets(spark, sf_dir):
    """Blocked targets go first and do not count as seen."""
    kept = dedup.clean_unique(flagged(spark, sf_dir).select("source", "place", "ord", "target_index", "id", "blocked"), ["place", "ord", "target_index"])
    return kept.drop("blocked")


@query(f"""WITH {SOURCED}, {BLOCKED}, {FLAGGED} SELECT fl.source, count(*) AS n_targets, count(*) FILTER (fl.blocked) AS n_blocked,
  count(*) FILTER (ok.k > 1) AS repeats, count(*) FILTER (ok.k = 1) AS kept FROM fl LEFT JOIN ok USING (source, ord, target_index) GROUP BY 1""")
def target_counters(spark, sf_dir):
    """A4: blocked targets and repeats, counted in that order."""
    return dedup.counters(flagged(spark, sf_dir))


# ---- split ----
def unique_targets(spark, sf_dir) -> DataFrame:
    return targets(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("ord") % 3).cast("string")).alias("source"), "id", "place").where("place = 0").drop("place").dropDuplicates(["id", "source"])


@query(f"""WITH {SOURCED}, u AS (SELECT DISTINCT 's' || (ord % 3) AS source, id FROM e WHERE place = 0), n AS (SELECT source, count(*) AS n FROM u GROUP BY 1),
x AS (SELECT source, n, 20.0 * n / sum(n) OVER () AS exact, row_number() OVER (ORDER BY source) AS i FROM n),
y AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, i) AS r FROM x),
a AS (SELECT source, base + CASE WHEN r <= 20 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM y),
z AS (SELECT u.*, quota, row_number() OVER (PARTITION BY source ORDER BY sha256('validation:' || id)) AS t FROM u JOIN a USING (source))
SELECT source, id, t <= quota AS validation FROM z""")
def validation_split(spark, sf_dir):
    """A validation set of 20, allocated by largest remainder and drawn by hash."""
    rows = unique_targets(spark, sf_dir)
    counts = rows.groupBy("source").agg(F.count("*").alias("n")).withColumn("place", F.col("source"))
    return split.with_split(rows, split.allocation(counts, 20)).select("source", "id", "validation")


# ---- rendering ----
ROLE_CAP = "upper(left(m.role, 1)) || lower(m.role[2:])"


@query(f"WITH {S.CONVERSATIONS} SELECT conv_id, '<bos>' || chr(10) || array_to_string(list_transform(conversation, lambda m: {ROLE_CAP} || ': ' || m.content), chr(10)) || chr(10) || '<eos>' AS text FROM conv")
def flat_chat(spark, sf_dir):
    """Conversations as flat text."""
    return conversations(spark, sf_dir).select("conv_id", chat.flat_text(F.col("conversation")).alias("text"))


HISTORY = "list_transform(range(1, len(u)), lambda i: 'User: ' || u[i].content || chr(10) || 'Assistant: ' || a[i].content)"


@query(f"""WITH {S.CONVERSATIONS}, s AS (SELECT conv_id, list_filter(conversation, lambda m: m.role = 'user') AS u, list_filter(conversation, lambda m: m.role = 'assistant') AS a FROM conv),
h AS (SELECT conv_id, u, {HISTORY} AS h FROM s WHERE len(u) <= len(a) + 1 AND len(u) > 0)
SELECT conv_id, array_to_string(h[greatest(len(h) - 1, 1):] || ['User: ' || u[len(u)].content, 'Assistant: '], chr(10)) AS prompt FROM h""")
def chat_prompt(spark, sf_dir):
    """The last two turns, the question, an open answer."""
    by = lambda r: F.filter("conversation", lambda m: m["role"] == r)
    c = conversations(spark, sf_dir).select("conv_id", by("user").alias("u"), by("assistant").alias("a")).where("size(u) <= size(a) + 1 and size(u) > 0")
    past = F.zip_with(F.slice("u", F.lit(1), F.size("u") - 1), F.slice("a", F.lit(1), F.size("u") - 1), lambda u, a: F.struct(u["content"].alias("user"), a["content"].alias("assistant")))
    rows = c.select("conv_id", "u", past.alias("h"))
    last = F.slice("h", F.greatest(F.size("h") - 1, F.lit(1)), F.lit(2))
    return rows.select("conv_id", chat.prompt(last, F.element_at("u", -1)["content"]).alias("prompt"))


@query(f"""WITH {S.CONVERSATIONS}, k AS (SELECT conv_id, conversation AS c, list_transform(conversation, lambda m: len({S.words('m.content')})) AS n FROM conv),
o AS (SELECT conv_id, c, coalesce(list_min(list_filter(range(len(c)), lambda i: (i % 2 = 0 OR i = len(c) - 1) AND list_sum(n[i + 1:]) < 60)), len(c) - 1) AS i FROM k)
SELECT conv_id, (len(c) - i)::INT AS n_messages, c[i + 1].content AS first FROM o""")
def fitting_history(spark, sf_dir):
    """The two oldest messages go until the rest fits in 60 tokens."""
    kept = conversations(spark, sf_dir).select("conv_id", chat.fitting_history(F.col("conversation"), 60, lambda m: F.size(T.words(m["content"]))).alias("k"))
    return kept.select("conv_id", F.size("k").alias("n_messages"), F.get("k", F.lit(0))["content"].alias("first"))


#: What stands in the middle of a reply, by its number; fixed: the markers that a reply is cut at.
STOPS = ["<eos> more", "\nUser: b<pad>", "<bos>y<eos>", "  plain \n", "", "\nAssistant: goes"]
_STOP = "CASE conv_id % 6 " + " ".join(f"WHEN {i} THEN {S.literal(x)}" for i, x in enumerate(STOPS)) + " END"


@query(f"""WITH r AS (SELECT conv_id, turn, left(text, length(text) // 2) || {_STOP} || substr(text, length(text) // 2 + 1) AS text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)
SELECT conv_id, turn, {S.strip("string_split(string_split(string_split(string_split(string_split(text, '<eos>')[1], '<pad>')[1], '<bos>')[1], chr(10) || 'User:')[1], chr(10) || 'Assistant:')[1]")} AS reply FROM r""")
def clean_replies(spark, sf_dir):
    """Replies cut at stop markers, which are put into the middle of every assistant message."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant' and text is not null")
    half = F.floor(F.length("text") / 2).cast("int")
    stop = F.element_at(F.array(*map(F.lit, STOPS)), (F.col("conv_id") % 6).cast("int") + 1)
    whole = F.concat(F.substring("text", F.lit(1), half), stop, F.substring("text", half + 1, F.length("text")))
    return c.select("conv_id", "turn", chat.clean_reply(whole).alias("reply"))


@query(f"WITH d AS (SELECT doc_id, {S.words('text')} AS w FROM documents) SELECT doc_id, array_to_string(['<s>'] || w[greatest(len(w) - 30, 0) + 1:], ' ') AS tokens FROM d")
def latest_tokens(spark, sf_dir):
    """X11: the latest tokens that fit in 32 with a begin marker; here 31 of them."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.array_join(packing.latest(T.words(F.col("text")), 31, F.lit("<s>")), " ").alias("tokens"))


# ---- samples ----
def samples(spark, sf_dir, all_turns: bool = False) -> DataFrame:
    """White-space samples: one for each assistant message, or one for each conversation with all of them labelled."""
    c = conversations(spark, sf_dir).withColumn("conversation", chat.canonical(F.col("conversation")))
    if all_turns:
        rows = c.where(F.exists("conversation", lambda m: m["role"] == "assistant")).select("conv_id", F.lit(None).cast("int").alias("target_index"), "conversation")
    else:
        rows = dedup.targets(c).select("conv_id", "target_index", F.col("prefix").alias("conversation"))
    texts = rows.withColumn("texts", packing.sample_texts(F.col("conversation"), F.col("target_index")))
    encoded = texts.withColumn("encoded", tokenize.white_space_all(F.transform("texts", lambda t: t["text"])))
    return encoded.select("conv_id", "target_index", packing.sample(F.col("texts"), F.col("encoded"), F.lit("<s>"), F.lit("</s>")).alias("tokens"))


def tensors(rows: DataFrame, length: int) -> DataFrame:
    made = rows.withColumn("t", packing.tensors(F.col("tokens"), length, F.lit("<pad>"), F.lit("-100")))
    return made.select("conv_id", "target_index", F.array_join("t.inputs", " ").alias("inputs"), F.array_join("t.labels", " ").alias("labels"))


def _sample_sql(targets_sql: str, labelled: str) -> str:
    ids = f"CASE WHEN m.role = 'assistant' THEN ['Assistant:'] || {S.words('m.content')} ELSE [{ROLE_CAP} || ':'] || {S.words('m.content')} END"
    labels = f"CASE WHEN m.role = 'assistant' AND {labelled} THEN ['-100'] || {S.words('m.content')} ELSE list_transform(range(1 + len({S.words('m.content')})), lambda x: '-100') END"
    return f"""WITH {S.CONVERSATIONS}, k AS (SELECT conv_id, {S.canonical('conversation')} AS c FROM conv), t AS ({targets_sql}),
s AS (SELECT conv_id, target_index, ['<s>'] || flatten(list_transform(p, lambda m: {ids})) || ['</s>'] AS i, ['-100'] || flatten(list_transform(p, lambda m, j: {labels})) || ['</s>'] AS l FROM t)"""


ONE_TARGET = "SELECT conv_id, (i - 1)::INT AS target_index, c[1:i] AS p FROM k, unnest(range(1, len(c) + 1)) AS u(i) WHERE c[i].role = 'assistant'"
ALL_TARGETS = "SELECT conv_id, NULL::INT AS target_index, c AS p FROM k WHERE len(list_filter(c, lambda m: m.role = 'assistant')) > 0"


@query(_sample_sql(ONE_TARGET, "j = len(p)") + " SELECT conv_id, target_index, array_to_string(i, ' ') AS inputs, array_to_string(l, ' ') AS labels FROM s")
def chat_samples(spark, sf_dir):
    """Samples with only the target's answer and the end marker labelled."""
    made = samples(spark, sf_dir)
    label = F.transform("tokens", lambda t: F.when(t["labelled"], t["token"]).otherwise("-100"))
    return made.select("conv_id", "target_index", F.array_join(F.transform("tokens", lambda t: t["token"]), " ").alias("inputs"), F.array_join(label, " ").alias("labels"))


PADDED = " SELECT conv_id, target_index, array_to_string((i || list_transform(range(96), lambda x: '<pad>'))[1:96], ' ') AS inputs, array_to_string((l || list_transform(range(96), lambda x: '-100'))[1:96], ' ') AS labels FROM s"


@query(_sample_sql(ALL_TARGETS, "TRUE") + PADDED)
def chat_samples_all_turns(spark, sf_dir):
    """Every answer labelled, cut on the right, padded to 96."""
    rows = samples(spark, sf_dir, all_turns=True)
    return tensors(rows.withColumn("tokens", packing.cut_right(F.col("tokens"), 96)), 96)


@query(None)
def chat_samples_truncated(spark, sf_dir):
    """Samples cut to 48 tokens with the prompt's tail and the answer's head and tail; tests hold it against brute force."""
    rows = samples(spark, sf_dir).withColumn("tokens", packing.truncated(F.col("tokens"), 48, T.words(F.lit(packing.GAP)), F.lit("<s>")))
    return tensors(rows, 48)


@query(_sample_sql(ONE_TARGET, "j = len(p)") + """, n AS (SELECT conv_id * 100 + target_index AS pos, len(i) AS seen, len(list_filter(l[2:], lambda x: x <> '-100')) AS sup FROM s)
SELECT pos, (sum(seen) OVER w)::BIGINT AS seen, (sum(sup) OVER w)::BIGINT AS supervised, (sum(seen) OVER w)::BIGINT AS not_padding FROM n WINDOW w AS (ORDER BY pos)""")
def token_counters(spark, sf_dir):
    """Running totals of positions and supervised tokens."""
    from ..operators import logs

    rows = samples(spark, sf_dir).select(
        (F.col("conv_id") * 100 + F.col("target_index")).alias("pos"), F.transform("tokens", lambda t: t["token"]).alias("inputs"),
        F.transform("tokens", lambda t: F.when(t["labelled"], t["token"]).otherwise("-100")).alias("labels"), F.lit("<pad>").alias("pad"),
    )
    return logs.counters(rows, ignored="-100")
