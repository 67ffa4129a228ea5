"""Benchmark items (prompt, choices, label) from task rows, candidates, and score aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# The prompts' texts.
SCIENCE = ("Answer the following multiple-choice science question.\nQuestion: ", "\nAnswer:")
CONTINUATION = ("Choose the most plausible continuation of the situation.\nContext: ", "\nContinuation:")
PHYSICAL = ("Choose the more sensible solution to the physical reasoning problem.\nGoal: ", "\nSolution:")
PASSAGE = ("Read the passage and answer the question with Yes or No.\nPassage: ", "\nQuestion: ", "\nAnswer:")
BLANK = ("Choose the sentence with the correct resolution of the blank.\nSentence: ", "\nResolved sentence:")
TRUTHFUL = ("Answer the question truthfully and avoid common misconceptions.\nQuestion: ", "\nAnswer:")


def around(texts: tuple[str, ...], *columns: Column) -> Column:
    """Fixed texts with columns in between."""
    parts: list[Column] = [F.lit(texts[0])]
    for c, t in zip(columns, texts[1:]):
        parts += [c, F.lit(t)]
    return F.concat(*parts)


def stripped(choices: Column) -> Column:
    return F.transform(choices, strip)


def place(labels: Column, value: Column) -> Column:
    """The first place, from 0, of a value; null if it is not there."""
    return F.nullif(F.array_position(labels, value), F.lit(0)) - 1


def answer_place(answer: Column, labels: Column) -> Column:
    """Where an answer key points: an equal label, one equal but for case, a place from 0, a place from 1. Raises if none."""
    a, n = strip(answer.cast("string")), F.size(labels)
    number = F.when(a.rlike(r"^\d{1,9}$"), a.cast("int"))
    found = F.coalesce(
        place(labels, a), place(F.transform(labels, F.upper), F.upper(a)), F.when(number < n, number), F.when(number.between(1, n), number - 1)
    )
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no label fits the answer "), F.coalesce(a, F.lit("null")))).cast("bigint")).cast("int")


def item(prompt: Column, choices: Column, label: Column) -> Column:
    """A checked item: there are choices, and the label is one of them; raises otherwise."""
    right = (F.size(choices) > 0) & (label >= 0) & (label < F.size(choices))
    checked = F.when(right, label.cast("int")).otherwise(F.raise_error(F.lit("the label is not one of the choices")).cast("int"))
    return F.struct(prompt.alias("prompt"), choices.alias("choices"), checked.alias("label"))


def arc(question: str = "question") -> Column:
    """Rows with a question, choices (text, label arrays) and an answer key; for the open-book task the stem is the question."""
    return item(around(SCIENCE, strip(F.col(question))), stripped(F.col("choices.text")), answer_place(F.col("answerKey"), F.col("choices.label")))


def open_book() -> Column:
    return arc("question_stem")


def hellaswag() -> Column:
    joined = F.concat(F.coalesce("ctx_a", F.lit("")), F.lit(" "), F.coalesce("ctx_b", F.lit("")))
    context = strip(F.coalesce(F.nullif(F.col("ctx"), F.lit("")), joined))
    return item(around(CONTINUATION, context), stripped(F.col("endings")), F.col("label").cast("int"))


def piqa() -> Column:
    return item(around(PHYSICAL, strip(F.col("goal"))), stripped(F.array("sol1", "sol2")), F.col("label").cast("int"))


def boolq() -> Column:
    q = strip(F.col("question"))
    asked = F.when((q == "") | F.right(q, F.lit(1)).isin("?", "!", "."), q).otherwise(F.concat(q, F.lit("?")))
    return item(around(PASSAGE, strip(F.col("passage")), asked), F.array(F.lit("No"), F.lit("Yes")), F.col("answer").cast("int"))


def winogrande() -> Column:
    s = strip(F.col("sentence"))
    choices = F.transform(stripped(F.array("option1", "option2")), lambda o: F.replace(s, F.lit("_"), o))
    return item(around(BLANK, s), choices, F.col("answer").cast("int") - 1)


def truthful() -> Column:
    label = F.coalesce(place(F.col("mc1_targets.labels"), F.lit(1)), F.raise_error(F.lit("no choice is right")).cast("bigint"))
    return item(around(TRUTHFUL, strip(F.col("question"))), stripped(F.col("mc1_targets.choices")), label)


#: Task name to the item of a row; others can be added.
NORMALIZERS: dict[str, Callable[[], Column]] = {
    "arc_easy": arc, "hellaswag": hellaswag, "piqa": piqa, "boolq": boolq, "winogrande": winogrande, "openbookqa": open_book, "truthfulqa_mc1": truthful,
}


def items(rows: DataFrame, task: str, index: str = "source_index") -> DataFrame:
    """(task, source_index, prompt, choices, label)."""
    return rows.select(F.lit(task).alias("task"), F.col(index).alias("source_index"), NORMALIZERS[task]().alias("i")).select("task", "source_index", "i.*")


def prepared(sources: dict[str, DataFrame], strict: bool = False) -> tuple[DataFrame | None, dict[str, str]]:
    """The items of all tasks, and by task what went wrong; with ``strict`` the first error is raised."""
    out, errors = None, {}
    for task, rows in sources.items():
        try:
            made = items(rows, task)
            made.agg(F.max("label"), F.max(F.hash("prompt"))).first()  # runs the checks
            out = made if out is None else out.unionByName(made)
        except Exception as e:  # one bad task must not stop the others
            if strict:
                raise
            errors[task] = str(e).split("\n")[0]
    return out, errors


def choice_rows(items_of: DataFrame) -> DataFrame:
    """One row for each choice: task, source_index, choice_index, prompt, choice."""
    return items_of.select("task", "source_index", "prompt", F.posexplode("choices").alias("choice_index", "choice"))


def predictions(items_of: DataFrame, scores: DataFrame) -> DataFrame:
    """Items with their scores in order of choice, and the best choice by sum and by mean; the first wins ties.

    ``scores`` has task, source_index, choice_index, log_likelihood, target_tokens.
    """
    mean = F.col("log_likelihood") / F.greatest(F.col("target_tokens"), F.lit(1))
    each = scores.withColumn("mean_log_likelihood", mean).groupBy("task", "source_index").agg(
        F.array_sort(F.collect_list(F.struct("choice_index", "log_likelihood", "mean_log_likelihood", "target_tokens"))).alias("scores")
    )

    def best(field: str) -> Column:
        values = F.transform("scores", lambda s: s[field])
        return place(values, F.array_max(values)).cast("int")

    met = items_of.join(each, ["task", "source_index"])
    out = met.withColumns({"prediction": best("log_likelihood"), "normalized_prediction": best("mean_log_likelihood")})
    return out.withColumns({"correct": F.col("prediction") == F.col("label"), "normalized_correct": F.col("normalized_prediction") == F.col("label")})


def interval(p: Column, n: Column) -> tuple[Column, Column]:
    """95% limits by the normal approximation, within [0, 1]; NaN for no rows."""
    half = 1.96 * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n)
    nan = F.lit(float("nan"))
    return F.when(n <= 0, nan).otherwise(F.greatest(p - half, F.lit(0.0))), F.when(n <= 0, nan).otherwise(F.least(p + half, F.lit(1.0)))


def task_summary(predicted: DataFrame) -> DataFrame:
    """By task: questions, accuracies, the chance level, tokens a choice, limits."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    tokens = F.aggregate("scores", F.lit(0).cast("long"), lambda t, s: t + s["target_tokens"])
    out = predicted.groupBy("task").agg(
        F.count("*").alias("questions"), rate("correct").alias("accuracy"), rate("normalized_correct").alias("normalized_accuracy"),
        F.avg(1 / F.size("choices")).alias("random_accuracy"), (F.sum(tokens) / F.sum(F.size("scores"))).alias("tokens_per_choice"),
    )
    low, high = interval(F.col("accuracy"), F.col("questions"))
    return out.withColumns({"low": low, "high": high})


def overall(summary: DataFrame) -> DataFrame:
    """All tasks: accuracies weighted by questions, and plain means over tasks."""
    weighted = lambda c: (F.sum(F.col(c) * F.col("questions")) / F.sum("questions"))
    return summary.agg(
        F.count("*").alias("tasks"), F.sum("questions").alias("questions"), weighted("accuracy").alias("weighted_accuracy"), weighted("normalized_accuracy").alias("weighted_normalized"),
        F.avg("accuracy").alias("macro_accuracy"), F.avg("normalized_accuracy").alias("macro_normalized"),
    )
