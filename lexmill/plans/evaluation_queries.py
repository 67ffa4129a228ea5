"""Registered queries over benchmark items, scores, perplexity and training logs. Inputs that no table holds are made from
rows of those that there are: task rows from the benchmark's words, log lines from events."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import benchmarks, logs, packing, perplexity
from . import sql as S

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


# ---- task rows: each text of the benchmark, its words taken for questions and choices, is a row of every task ----
def task_rows(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = T.once(b.select(F.col("item_id").cast("int").alias("source_index"), "text"), w=T.words(F.col("text"))).where(F.size("w") >= 12)
    k = F.col("source_index")
    word = lambda i: F.element_at("w", i)
    run = lambda i, j: F.array_join(F.slice("w", i, j - i + 1), " ")
    by_3 = lambda x, y, z: F.when(k % 3 == 0, x).when(k % 3 == 1, y).otherwise(z)
    texts = lambda *xs: F.array(*map(F.lit, xs))
    sp = F.lit(" ")
    question = F.concat(sp, run(1, 5), F.lit("? "))
    choices = F.struct(F.array(word(6), F.concat(word(7), sp), F.concat(sp, word(8))).alias("text"), by_3(texts("A", "B", "C"), texts("1", "2", "3"), texts("C", "D", "E")).alias("label"))
    key = by_3(F.when(k % 2 == 0, "b").otherwise("C"), F.lit("3"), F.lit("0"))
    return {
        "arc_easy": rows.select("source_index", question.alias("question"), choices.alias("choices"), key.alias("answerKey")),
        "openbookqa": rows.select("source_index", question.alias("question_stem"), choices.alias("choices"), key.alias("answerKey")),
        "hellaswag": rows.select(
            "source_index", F.when(k % 2 == 0, F.concat(run(1, 6), sp)).otherwise("").alias("ctx"), run(1, 3).alias("ctx_a"), run(4, 6).alias("ctx_b"),
            F.array(F.concat(word(7), sp), word(8), F.concat(sp, word(9))).alias("endings"), (k % 3).cast("int").alias("label"),
        ),
        "piqa": rows.select("source_index", F.concat(sp, run(1, 5), sp).alias("goal"), word(6).alias("sol1"), F.concat(sp, run(7, 9)).alias("sol2"), (k % 2).cast("int").alias("label")),
        "boolq": rows.select("source_index", F.concat(run(1, 4), by_3(F.lit(""), F.lit("?"), F.lit("."))).alias("question"), F.concat(sp, F.col("text"), sp).alias("passage"), (k % 2 == 0).alias("answer")),
        "winogrande": rows.select("source_index", F.concat(word(1), F.lit(" _ "), word(2), F.lit(" the _ .")).alias("sentence"), F.concat(word(6), sp).alias("option1"), word(7).alias("option2"), (k % 2 + 1).cast("string").alias("answer")),
        "truthfulqa_mc1": rows.select("source_index", question.alias("question"), F.struct(F.array(F.concat(sp, word(6)), word(7), word(8)).alias("choices"), F.array(*[(k % 3 == i).cast("int") for i in range(3)]).alias("labels")).alias("mc1_targets")),
    }


def all_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, errors = benchmarks.prepared(task_rows(spark, sf_dir), strict=True)
    return items


NL = "chr(10)"


def _prompt(texts, *columns) -> str:
    parts = [S.literal(texts[0])]
    for c, t in zip(columns, texts[1:]):
        parts += [c, S.literal(t)]
    return " || ".join(parts)


def _trim(c: str) -> str:
    return f"list_transform({c}, lambda x: {S.strip('x')})"


def _answer(a: str, labels: str) -> str:
    number = f"CASE WHEN regexp_matches({a}, '^[0-9]+$') THEN {a}::INT END"
    return f"coalesce(list_position({labels}, {a}), list_position(list_transform({labels}, lambda x: upper(x)), upper({a})), CASE WHEN {number} < len({labels}) THEN {number} + 1 END, {number}) - 1"


def _items_sql() -> str:
    def part(task, fields, prompt, choices, label):
        return f"SELECT '{task}' AS task, source_index, {prompt} AS prompt, {choices} AS choices, ({label})::INT AS label FROM (SELECT k AS source_index, {fields} FROM bw)"

    run = lambda i, j: f"array_to_string(w[{i}:{j}], ' ')"
    by_3 = lambda x, y, z: f"CASE k % 3 WHEN 0 THEN {x} WHEN 1 THEN {y} ELSE {z} END"
    arc = (_trim("choices"), _answer("answerKey", "labels"))
    asked = f"' ' || {run(1, 5)} || '? ' AS question"
    science = f"""{asked}, [w[6], w[7] || ' ', ' ' || w[8]] AS choices, {by_3("['A', 'B', 'C']", "['1', '2', '3']", "['C', 'D', 'E']")} AS labels,
      {by_3("CASE WHEN k % 2 = 0 THEN 'b' ELSE 'C' END", "'3'", "'0'")} AS "answerKey\""""
    q = f"{S.strip('question')}"
    return " UNION ALL ".join([
        part("arc_easy", science, _prompt(benchmarks.SCIENCE, q), *arc),
        part("openbookqa", science, _prompt(benchmarks.SCIENCE, q), *arc),
        part("hellaswag", f"CASE WHEN k % 2 = 0 THEN {run(1, 6)} || ' ' ELSE '' END AS ctx, {run(1, 3)} AS ctx_a, {run(4, 6)} AS ctx_b, [w[7] || ' ', w[8], ' ' || w[9]] AS endings, k % 3 AS label", _prompt(benchmarks.CONTINUATION, S.strip("CASE WHEN ctx <> '' THEN ctx ELSE ctx_a || ' ' || ctx_b END")), _trim("endings"), "label"),
        part("piqa", f"' ' || {run(1, 5)} || ' ' AS goal, w[6] AS sol1, ' ' || {run(7, 9)} AS sol2, k % 2 AS label", _prompt(benchmarks.PHYSICAL, S.strip("goal")), _trim("[sol1, sol2]"), "label"),
        part("boolq", f"{run(1, 4)} || {by_3(chr(39) * 2, chr(39) + '?' + chr(39), chr(39) + '.' + chr(39))} AS question, ' ' || text || ' ' AS passage, k % 2 = 0 AS answer", _prompt(benchmarks.PASSAGE, S.strip("passage"), f"CASE WHEN {q} = '' OR right({q}, 1) IN ('?', '!', '.') THEN {q} ELSE {q} || '?' END"), "['No', 'Yes']", "answer::INT"),
        part("winogrande", "w[1] || ' _ ' || w[2] || ' the _ .' AS sentence, w[6] || ' ' AS option1, w[7] AS option2, k % 2 + 1 AS answer", _prompt(benchmarks.BLANK, S.strip("sentence")), f"list_transform([{S.strip('option1')}, {S.strip('option2')}], lambda x: replace({S.strip('sentence')}, '_', x))", "answer::INT - 1"),
        part("truthfulqa_mc1", f"{asked}, [' ' || w[6], w[7], w[8]] AS options, k % 3 AS right_one", _prompt(benchmarks.TRUTHFUL, q), _trim("options"), "right_one"),
    ])


ITEMS = f"bw AS (SELECT * FROM (SELECT item_id::INT AS k, text, {S.words('text')} AS w FROM benchmark) WHERE len(w) >= 12), items AS ({_items_sql()})"


@query(f"WITH {ITEMS} SELECT task, source_index, prompt, array_to_string(choices, '|') AS choices, label FROM items")
def benchmark_items(spark, sf_dir):
    """Task rows as prompts, choices and labels."""
    return all_items(spark, sf_dir).select("task", "source_index", "prompt", F.array_join("choices", "|").alias("choices"), "label")


# A device for tests: a choice's log-likelihood is minus its words that the prompt lacks; it has a token for each word.
def scores(items: DataFrame) -> DataFrame:
    c = benchmarks.choice_rows(items)
    w, p = T.words(F.col("choice")), T.words(F.col("prompt"))
    missing = F.size(F.filter(F.col("w"), lambda x: ~F.array_contains("p", x)))
    return c.withColumns({"w": w, "p": p}).select("task", "source_index", "choice_index", (-missing).cast("double").alias("log_likelihood"), F.size("w").cast("long").alias("target_tokens"))


def predicted(spark, sf_dir) -> DataFrame:
    items = all_items(spark, sf_dir)  # once: its checks are jobs
    return benchmarks.predictions(items, scores(items))


SCORES = f"""sc AS (SELECT task, source_index, label, len(choices) AS n, (i - 1)::INT AS choice_index, {S.words('choices[i]')} AS w, {S.words('prompt')} AS p FROM items, unnest(range(1, len(choices) + 1)) AS u(i)),
ll AS (SELECT *, (0 - len(list_filter(w, lambda x: NOT list_contains(p, x))))::DOUBLE AS log_likelihood, len(w)::BIGINT AS target_tokens FROM sc),
pr AS (SELECT task, source_index, label, n, sum(target_tokens) AS tok, list(choice_index ORDER BY log_likelihood DESC, choice_index)[1] AS prediction,
  list(choice_index ORDER BY log_likelihood / greatest(target_tokens, 1) DESC, choice_index)[1] AS normalized_prediction FROM ll GROUP BY ALL)"""


@query(f"WITH {ITEMS}, {SCORES} SELECT task, source_index, choice_index, log_likelihood, target_tokens FROM ll")
def candidate_scores(spark, sf_dir):
    """A row for each choice with its score."""
    return scores(all_items(spark, sf_dir))


@query(f"WITH {ITEMS}, {SCORES} SELECT task, source_index, label, prediction, normalized_prediction, prediction = label AS correct, n AS n_scores FROM pr")
def benchmark_predictions(spark, sf_dir):
    """The best choice by sum and by mean; the first wins ties."""
    return predicted(spark, sf_dir).select("task", "source_index", "label", "prediction", "normalized_prediction", "correct", F.size("scores").cast("long").alias("n_scores"))


SUMMARY = f"""{ITEMS}, {SCORES}, sm AS (SELECT task, count(*) AS questions, avg((prediction = label)::INT) AS accuracy, avg((normalized_prediction = label)::INT) AS normalized_accuracy,
  avg(1.0::DOUBLE / n) AS random_accuracy, sum(tok) / sum(n) AS tokens_per_choice FROM pr GROUP BY 1)"""


@query(f"""WITH {SUMMARY} SELECT task, questions, round(accuracy, 9) AS accuracy, round(normalized_accuracy, 9) AS normalized_accuracy, round(random_accuracy, 9) AS random_accuracy, round(tokens_per_choice, 9) AS tokens_per_choice,
  round(low, 9) AS low, round(high, 9) AS high FROM (SELECT *, greatest(accuracy - 1.96 * sqrt(greatest(accuracy * (1 - accuracy), 0) / questions), 0) AS low,
  least(accuracy + 1.96 * sqrt(greatest(accuracy * (1 - accuracy), 0) / questions), 1) AS high FROM sm)""")
def benchmark_summary(spark, sf_dir):
    """Accuracies, chance, tokens a choice and limits by task."""
    out = benchmarks.task_summary(predicted(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c not in {"task", "questions"}})


@query(f"""WITH {SUMMARY} SELECT count(*) AS tasks, sum(questions)::BIGINT AS questions, round(sum(accuracy * questions) / sum(questions), 9) AS weighted_accuracy,
  round(sum(normalized_accuracy * questions) / sum(questions), 9) AS weighted_normalized, round(avg(accuracy), 9) AS macro_accuracy, round(avg(normalized_accuracy), 9) AS macro_normalized FROM sm""")
def benchmark_overall(spark, sf_dir):
    """Weighted and plain means over tasks."""
    out = benchmarks.overall(benchmarks.task_summary(predicted(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c not in {"tasks", "questions"}})


@query(None)
def candidate_encoding(spark, sf_dir):
    """Ids of prompt and choice with the places that are scored."""
    import public_tokenizers

    from ..functions.tokenize import encode_texts

    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.candidates(benchmarks.choice_rows(all_items(spark, sf_dir)), lambda texts: encode_texts(path, texts), 1024)


# ---- perplexity: a uniform model over V tokens gives ln V nats for each white-space token ----
MODELS = [("uniform4", 4), ("uniform64", 64), ("uniform2", 2)]


def all_texts(spark, sf_dir) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.lit("benchmark").alias("dataset"), F.col("item_id").alias("ord"), "text")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lit("documents").alias("dataset"), F.col("doc_id").alias("ord"), "text")
    return b.unionByName(d)


TEXTS = "src AS (SELECT 'benchmark' AS dataset, item_id AS ord, coalesce(text, '') AS text FROM benchmark UNION ALL SELECT 'documents', doc_id, coalesce(text, '') FROM documents)"
LEVELS = ", ".join(f"l{k + 1} AS (SELECT dataset, k // {perplexity.FANOUT} AS k, sha256(string_agg(digest, '' ORDER BY k)) AS digest FROM l{k} GROUP BY 1, 2)" for k in range(perplexity.LEVELS))


@query(f"""WITH {TEXTS}, l0 AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY ord) - 1 AS k, sha256(text) AS digest FROM src), {LEVELS},
s AS (SELECT dataset, count(*) AS n_rows, (sum(strlen(text)) + 2 * (count(*) - 1))::BIGINT AS bytes FROM src GROUP BY 1)
SELECT s.dataset, n_rows, bytes, digest AS tree_sha256 FROM s JOIN l{perplexity.LEVELS} USING (dataset)""")
def evaluation_corpora(spark, sf_dir):
    """S11 over every row: rows, bytes of the joined texts, and a tree's digest of them, since one text cannot hold a whole table."""
    return perplexity.corpus_sums(all_texts(spark, sf_dir), "ord")


def scored(segments: DataFrame) -> DataFrame:
    """Rows of (dataset, tokens) under each of MODELS."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(v).alias("v")) for m, v in MODELS])
    each = segments.select("dataset", "tokens", F.explode(models).alias("m"))
    return each.select("m.model", "dataset", (F.col("tokens") * F.log(F.col("m.v").cast("double"))).alias("nll"), "tokens")


def perplexities(spark, sf_dir) -> DataFrame:
    rows = all_texts(spark, sf_dir)
    sizes = rows.groupBy("dataset").agg((F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long")) + 2 * (F.count("*") - 1)).alias("bytes"))
    return perplexity.results(scored(perplexity.segment_sizes(rows, "ord", 128)), sizes)


PPL = f"""{TEXTS}, n AS (SELECT dataset, sum(strlen(text)) + 2 * (count(*) - 1) AS bytes, sum(len({S.words('text')})) AS tokens FROM src GROUP BY 1), m AS {S.values(MODELS, 'model, v')},
r AS (SELECT model, dataset, tokens::BIGINT AS tokens, ((tokens + 126) // 127)::BIGINT AS segments, bytes::BIGINT AS bytes, tokens * ln(v) AS nll FROM n, m),
p AS (SELECT *, nll / tokens AS nats_per_token, exp(least(nll / tokens, 50)) AS perplexity, nll / (bytes * {math.log(2)}) AS bits_per_byte, 2 ** (nll / (bytes * {math.log(2)})) AS byte_perplexity, tokens / bytes AS tokens_per_byte FROM r)"""


def _brief(name: str) -> str:
    return f"round({name}, 9) AS {name}"


@query(f"""WITH {PPL} SELECT dataset, model, round(nll, 3) AS nll, tokens, segments, bytes, {', '.join(map(_brief, ('nats_per_token', 'perplexity', 'bits_per_byte', 'byte_perplexity', 'tokens_per_byte')))} FROM p""")
def perplexity_results(spark, sf_dir):
    """Perplexity and bits per byte by model and dataset, over every row (rounded: sums of doubles)."""
    out = perplexities(spark, sf_dir).withColumn("nll", F.round("nll", 3))
    return out.withColumns({c: F.round(c, 9) for c in ("nats_per_token", "perplexity", "bits_per_byte", "byte_perplexity", "tokens_per_byte")})


@query(f"WITH {PPL} SELECT model, round(bits_per_byte, 9) AS bits_per_byte FROM p WHERE dataset = 'benchmark'")
def perplexity_ranking(spark, sf_dir):
    """A dataset's models, best first (compared as a set)."""
    return perplexity.ranked(perplexities(spark, sf_dir), "benchmark").select("model", F.round("bits_per_byte", 9).alias("bits_per_byte"))


@query("""SELECT model, dataset FROM (SELECT DISTINCT source AS model FROM documents), (SELECT DISTINCT lang AS dataset FROM documents)
EXCEPT SELECT source, lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1""")
def pending_evaluations(spark, sf_dir):
    """Pairs of a source, as a model, and a language, as a dataset, without a result; toxic documents stand for results."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("model"), F.col("lang").alias("dataset"))
    done = d.join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("model", "dataset").distinct()
    return perplexity.pending(d.select("model").distinct(), d.select("dataset").distinct(), done)


@query("""WITH o AS (SELECT source AS name, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT source AS name, sum(n_chars)::BIGINT AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1
UNION ALL SELECT 'benchmark', count(*) FROM benchmark)
SELECT coalesce(w.name, o.name) AS name, coalesce(w.n, o.n) AS n_rows FROM o FULL JOIN w ON o.name = w.name""")
def dataset_upsert(spark, sf_dir):
    """New rows replace those of the same name: sources' documents, and in their place the characters of toxic ones."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old = d.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n_rows"))
    toxic = d.join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id"), "doc_id")
    new = toxic.groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").alias("n_rows"))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").agg(F.lit("benchmark").alias("name"), F.count("*").alias("n_rows"))
    return perplexity.upserted(old, new.unionByName(bench), "name")


# ---- logs ----
def log_lines(spark, sf_dir) -> DataFrame:
    """Every event as a log line of a training step, with repeats, broken lines, NULs and bad losses; every 40th is a validation too."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), "value")
    i, loss = F.col("id"), 1 + F.col("value") / 100
    step = F.when(i % 8 == 7, i - 5).otherwise(i)
    text = F.format_string('{"type": "train", "step": %d, "loss": %.6f, "lr": 0.001, "total_seen_tokens": %d, "total_supervised_tokens": %d, "cumulative_gpu_time_seconds": %d.5}', step, loss, step * 1024, step * 300 + step % 5, step * 3)
    line = F.when(i % 97 == 5, F.lit("{broken")).when(i % 89 == 7, F.lit("")).when(i % 83 == 9, F.lit('{"type": "train", "step": 3, "loss": NaN}')).when(i % 79 == 11, F.concat(text, F.lit("\0"))).otherwise(text)
    valid = F.format_string('{"type": "validation", "step": %d, "loss": %.6f}', i, 1 + F.col("value") / 50)
    return e.select((2 * i).alias("ord"), line.alias("value")).unionByName(e.where("id % 40 = 0").select((2 * i + 1).alias("ord"), valid.alias("value")))


LOG = """raw AS (SELECT event_id AS id, value, CASE WHEN event_id % 8 = 7 THEN event_id - 5 ELSE event_id END AS step FROM events),
ev AS (SELECT 'train' AS type, 2 * id AS ord, step, round(1 + value / 100, 6) AS loss, step * 1024 AS seen, step * 300 + step % 5 AS sup, step * 3 + 0.5::DOUBLE AS seconds
  FROM raw WHERE id % 97 <> 5 AND id % 89 <> 7 AND id % 83 <> 9
  UNION ALL SELECT 'validation', 2 * id + 1, id, round(1 + value / 50, 6), NULL, NULL, NULL FROM raw WHERE id % 40 = 0),
lg AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY type, step ORDER BY ord DESC) = 1), tr AS (SELECT * FROM lg WHERE type = 'train')"""


def events(spark, sf_dir, kind: str) -> DataFrame:
    return logs.latest_by_step(logs.parsed(log_lines(spark, sf_dir))).where(F.col("type") == kind)


@query(f"WITH {LOG} SELECT type, step, ord, loss FROM lg")
def log_records(spark, sf_dir):
    """Good events, the last of each step."""
    return logs.latest_by_step(logs.parsed(log_lines(spark, sf_dir))).select("type", "step", "ord", "loss")


@query(f"WITH {LOG} SELECT step, CASE WHEN row_number() OVER (ORDER BY step) < 200 THEN 'nan'::DOUBLE ELSE round(avg(loss) OVER (ORDER BY step ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 9) END AS rolling FROM tr")
def log_rolling_mean(spark, sf_dir):
    """The mean of the latest 200 losses."""
    return logs.rolling_mean(events(spark, sf_dir, "train"), 200).select("step", F.round("rolling", 9).alias("rolling"))


@query(f"WITH {LOG}, x AS (SELECT step, row_number() OVER (ORDER BY step) - 1 AS i, seen - lag(seen, 200) OVER (ORDER BY step) AS ds, sup - lag(sup, 200) OVER (ORDER BY step) AS du FROM tr) SELECT step, 100 * du / ds AS density FROM x WHERE i > 0 AND i % 200 = 0 AND ds > 0")
def log_density(spark, sf_dir):
    """The share of supervised tokens by 200 rows."""
    return logs.density(events(spark, sf_dir, "train"))


@query(f"WITH {LOG}, x AS (SELECT step, row_number() OVER (ORDER BY step) - 1 AS i, greatest(1, count(*) OVER () // 100) AS k FROM tr) SELECT step FROM x WHERE i % k = 0")
def log_thinned(spark, sf_dir):
    """Every k-th row."""
    return logs.thinned(events(spark, sf_dir, "train"), 100).select("step")


@query(f"""WITH {LOG}, a AS (SELECT max(step) AS cur, (SELECT avg(loss) FROM (SELECT loss FROM tr ORDER BY step DESC LIMIT 500)) AS cm, coalesce(avg(loss) FILTER (step BETWEEN 1 AND 500), arg_min(loss, step)) AS bm,
  coalesce(min(step) FILTER (step >= 500), min(step)) AS fs, arg_max(seconds, step) AS s1 FROM tr), b AS (SELECT a.*, seconds AS s0 FROM a JOIN tr ON step = fs)
SELECT cur AS current_step, round(cm, 9) AS current_mean, round(bm, 9) AS baseline_mean, round((bm - cm) / bm * 100, 7) AS improvement, least(cur / 1000, 1) AS progress, (s1 - s0) / (cur - fs) AS seconds_per_step, (1000 - cur) * (s1 - s0) / (cur - fs) / 3600 AS hours_left FROM b""")
def log_progress(spark, sf_dir):
    """Recent and earlier means, pace, time left."""
    out = logs.progress(events(spark, sf_dir, "train"), 500, 1000)
    return out.withColumns({"current_mean": F.round("current_mean", 9), "baseline_mean": F.round("baseline_mean", 9), "improvement": F.round("improvement", 7)})


@query(f"WITH {LOG} SELECT step, loss, coalesce(loss < min(loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS improved FROM lg WHERE type = 'validation'")
def log_running_best(spark, sf_dir):
    """Validations that beat all before."""
    return logs.running_best(events(spark, sf_dir, "validation")).select("step", "loss", "improved")


@query("""WITH s AS (SELECT event_id AS step, NOT (event_id % 40 > 20 OR value > 120) AS ok FROM events), g AS (SELECT *, sum(ok::INT) OVER (ORDER BY step) AS i FROM s),
f AS (SELECT step, ok, CASE WHEN ok THEN 0 ELSE sum((NOT ok)::INT) OVER (PARTITION BY i ORDER BY step) END::BIGINT AS failed FROM g) SELECT *, failed >= 10 AS abort FROM f""")
def log_failures(spark, sf_dir):
    """Steps in a row that failed; events of a high value, and half of all, stand for those."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return logs.failures(e.select(F.col("event_id").alias("step"), (~((F.col("event_id") % 40 > 20) | (F.col("value") > 120))).alias("ok")))


@query("""SELECT event_id AS step, round(CASE WHEN event_id <= 100 THEN 0.001 * event_id / 100 ELSE 0.001 * (0.1 + 0.45 * (1 + cos(pi() * least((event_id - 100) / 900, 1)))) END::DOUBLE, 12) AS lr FROM events""")
def learning_rates(spark, sf_dir):
    """Warm-up and cosine, a step for each event."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("step"), F.round(T.learning_rate(F.col("event_id"), 1000, 0.001, 100), 12).alias("lr"))


@query("""WITH b AS (SELECT CASE event_id % 10 WHEN 3 THEN 'nan'::DOUBLE WHEN 7 THEN 'inf'::DOUBLE ELSE value / 100 END AS loss, event_id % 5 * 10 AS targets FROM events),
m AS (SELECT sum(loss * targets) / sum(targets) AS loss FROM b WHERE targets > 0 AND isfinite(loss)), p AS (SELECT avg(loss) AS l FROM b WHERE isfinite(loss))
SELECT round(m.loss, 9) AS loss, round(exp(least(m.loss, 20)), 9) AS perplexity, round(p.l, 9) AS plain FROM m, p""")
def validation_loss(spark, sf_dir):
    """Mean losses by targets and plainly, over finite batches, one for each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id") % 10
    b = e.select(F.when(k == 3, float("nan")).when(k == 7, float("inf")).otherwise(F.col("value") / 100).alias("loss"), (F.col("event_id") % 5 * 10).alias("targets"))
    plain = logs.plain_loss(b).select(F.lit(1).alias("one"), F.col("loss").alias("plain"))
    both = logs.weighted_loss(b).withColumn("one", F.lit(1)).join(plain, "one")  # a row each
    return both.select(*[F.round(c, 9).alias(c) for c in ("loss", "perplexity", "plain")])


@query("""WITH s AS (SELECT event_id AS ord, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -value ELSE value * 1000 END AS seconds FROM events), n AS (SELECT ord, seconds, floor(greatest(seconds, 0))::BIGINT AS t FROM s)
SELECT ord, CASE WHEN seconds IS NULL THEN 'not available' WHEN t >= 86400 THEN (t // 86400) || 'd ' || (t // 3600 % 24) || 'h ' || (t // 60 % 60) || 'm' WHEN t >= 3600 THEN (t // 3600) || 'h ' || (t // 60 % 60) || 'm' ELSE (t // 60) || 'm' END AS text FROM n""")
def durations(spark, sf_dir):
    """Seconds in words; events' values are taken for them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, -F.col("value")).otherwise(F.col("value") * 1000)
    return e.select(F.col("event_id").alias("ord"), T.duration(seconds).alias("text"))


@query("""SELECT event_type, CASE WHEN l IS NULL THEN 'not available' ELSE printf('%.4f', l) END AS last_loss
FROM (SELECT event_type, arg_max(struct_pack(l := CASE WHEN event_id % 3 = 0 THEN value / 8 WHEN event_id % 5 > 0 THEN value / 4 END), event_id).l AS l FROM events GROUP BY 1)""")
def last_logged_loss(spark, sf_dir):
    """P25: the last record's loss, by type of event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    rows = e.select("event_type", k.alias("ord"), F.when(k % 3 == 0, F.col("value") / 8).alias("eval_loss"), F.when(k % 5 > 0, F.col("value") / 4).alias("loss"))
    return logs.last_loss(rows, by="event_type")
