"""Chat rows from the shapes that public instruction and question sets come in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chat
from ..functions.text import non_blank, strip
from ..operators.benchmarks import place


def conversation_source(rows: DataFrame, messages: str = "messages", limit: int | None = None, order: str = "ord") -> DataFrame:
    """Canonical conversations of the first ``limit`` rows; roles are matched as they are written."""
    first = rows if limit is None else rows.where(F.col(order) < limit)
    return first.select(order, chat.canonical(F.col(messages), exact=True).alias("conversation"))


def broad_source(rows: DataFrame, messages: str = "messages", limit: int | None = None, order: str = "ord") -> DataFrame:
    """Of the first ``limit`` rows, the conversations with known roles that have a user and an assistant."""
    first = rows if limit is None else rows.where(F.col(order) < limit)
    return first.select(order, chat.broad(F.col(messages)).alias("conversation")).where("conversation is not null")


def short_source(rows: DataFrame, limit: int, messages: str = "messages", order: str = "ord") -> DataFrame:
    """Of the first ``limit`` rows with two messages of user and assistant, the first eight; then those that can be written."""
    kept = rows.select(order, chat.first_turns(F.col(messages)).alias("conversation")).where("conversation is not null")
    counted = kept.orderBy(order).limit(limit)
    return counted.select(order, chat.writable(F.col("conversation")).alias("conversation")).where("conversation is not null")


def problem_source(rows: DataFrame, problem: str = "problem", solution: str = "solution", order: str = "ord") -> DataFrame:
    """Problems with their solutions, as pairs."""
    return rows.select(order, chat.pair(F.col(problem), F.col(solution)).alias("conversation"))


def instruction_source(rows: DataFrame, title: str, instruction: str = "instruction", context: str = "context", answer: str = "response", order: str = "ord") -> DataFrame:
    """Instructions with a titled context where there is one; rows with a blank instruction or answer go."""
    kept = rows.where(non_blank(F.col(instruction)).isNotNull() & non_blank(F.col(answer)).isNotNull())
    return kept.select(order, chat.pair(chat.with_context(F.col(instruction), F.col(context), title), F.col(answer)).alias("conversation"))


# Fixed texts: how questions of the choice and reading sources are put and answered.
CHOICE_ASKED, CHOICE_SAID = "Choose the correct answer and explain briefly.\nQuestion: ", "The correct answer is "
READING_ASKED, READING_QUESTION = "Read the passage and answer Yes or No.\nPassage: ", "\nQuestion: "


def lettered(labels: Column, choices: Column) -> Column:
    """Choices as lines ``label. text``, with the source's own labels."""
    return F.array_join(F.zip_with(labels, choices, lambda k, c: F.concat(k, F.lit(". "), c)), "\n")


def choice_source(rows: DataFrame, question: str = "question", choices: str = "choices", labels: str = "labels", answer: str = "answer", order: str = "ord") -> DataFrame:
    """Multiple choice as a question with labelled choices, answered by label and text. An answer that is no label is an error."""
    found = place(F.transform(labels, lambda k: F.upper(strip(k))), F.upper(strip(F.col(answer))))
    at = F.coalesce(found, F.raise_error(F.concat(F.lit("the answer is none of the labels: "), F.coalesce(answer, F.lit("null")))).cast("bigint")).cast("int")
    asked = F.concat(F.lit(CHOICE_ASKED), F.col(question), F.lit("\n"), lettered(F.col(labels), F.col(choices)))
    said = F.concat(F.lit(CHOICE_SAID), F.get(F.col(labels), at), F.lit(": "), F.get(F.col(choices), at), F.lit("."))
    return rows.select(order, chat.pair(asked, said).alias("conversation"))


def reading_source(rows: DataFrame, passage: str = "passage", question: str = "question", answer: str = "answer", order: str = "ord") -> DataFrame:
    """A passage and a question that is answered by Yes or No."""
    asked = F.concat(F.lit(READING_ASKED), F.col(passage), F.lit(READING_QUESTION), F.col(question), F.lit("?"))
    return rows.select(order, chat.pair(asked, F.when(F.col(answer), "Yes.").otherwise("No.")).alias("conversation"))


# Fixed texts of the generated repair set: greetings, capitals, concepts, and answers of their own.
GREETINGS, GREETED = ("hello", "hi", "hey", "good morning"), "Hello! How can I help you?"
CAPITALS = {
    "france": ("France", "Paris"),
    "germany": ("Germany", "Berlin"),
    "japan": ("Japan", "Tokyo"),
    "malaysia": ("Malaysia", "Kuala Lumpur"),
    "canada": ("Canada", "Ottawa"),
    "united states": ("United States", "Washington, D.C."),
    "united kingdom": ("United Kingdom", "London"),
}
CONCEPTS = {
    "cat": "A cat is a small domesticated mammal often kept as a pet. Cats have fur, whiskers, claws, and are known for purring, climbing, and hunting.",
    "dog": "A dog is a domesticated mammal often kept as a pet or working animal. Dogs are known for loyalty, barking, strong smell, and learning commands.",
    "chicken": "A chicken is a domesticated bird kept for eggs and meat. Chickens have feathers, beaks, wings, and often live on farms.",
    "cow": "A cow is a large domesticated mammal often raised for milk and meat. Cows eat grass and are common farm animals.",
    "horse": "A horse is a large domesticated mammal used for riding, transport, farming, and sport.",
    "bird": "A bird is an animal with feathers, wings, a beak, and eggs. Many birds can fly.",
    "fish": "A fish is an animal that lives in water, breathes with gills, and usually has fins and scales.",
    "ghost": "A ghost is usually described in stories as the spirit of a dead person. There is no reliable scientific evidence that ghosts exist.",
    "robot": "A robot is a machine that can be programmed to do tasks. Robots can work in factories, homes, hospitals, or research labs.",
    "computer": "A computer is an electronic machine that processes information by following instructions called programs.",
}
CONCEPT_PROMPTS = ("what is a {}", "What is a {}?", "Explain what a {} is.")
UNKNOWN = "I don't know. I should not invent an answer when I do not have reliable information."
OTHERS = [
    ("Who won the private moon chess championship in 1842?", UNKNOWN),
    ("What is the serial number of my neighbor's laptop?", UNKNOWN),
    ("Write a 3 sentence story about a robot.", "A small robot found a lost seed beside the road. It planted the seed and watered it every morning. By summer, the robot rested in the shade of a bright green tree."),
]

# Fixed texts of the generated logic set.
LOGIC_PAIRS = [
    ("If all birds have wings and a robin is a bird, does a robin have wings?", "Yes. A robin is a bird, and all birds in the premise have wings."),
    ("If it rains, the ground gets wet. It is raining. What follows?", "The ground gets wet."),
    ("If it rains, the ground gets wet. The ground is wet. Did it necessarily rain?", "No. The ground could be wet for another reason, so the conclusion does not necessarily follow."),
    ("A box contains only red and blue balls. It contains no red balls. What color are the balls?", "The balls are blue, because the box contains only red and blue balls and no red balls."),
    ("What is the capital of France?", "The capital of France is Paris."),
    ("What is the capital of Japan?", "The capital of Japan is Tokyo."),
    ("Explain what a cat is in one sentence.", "A cat is a small domesticated mammal often kept as a companion."),
    ("What is a triangle?", "A triangle is a shape with three straight sides and three angles."),
    ("Who won the private moon chess championship in 1842?", "I do not know. I should not invent an answer without reliable evidence."),
    ("Is there reliable scientific evidence that ghosts exist?", "No reliable scientific evidence currently shows that ghosts exist."),
    ("A fair coin is flipped once. What is the probability of heads?", "For a fair coin, heads has probability 1/2, or 50 percent."),
    ("Sam is taller than Lee. Lee is taller than Pat. Who is tallest?", "Sam is tallest, because Sam is taller than Lee and Lee is taller than Pat."),
]


# Questions with operands, and their answers.
LOGIC_TEMPLATES = [
    ("What is {a} + {b}?", "{a} + {b} = {sum}."),
    ("What is {high} - {low}?", "{high} - {low} = {less}."),
    ("What is {e} times {f}?", "{e} times {f} = {times}."),
    ("What is {gh} divided by {h}?", "{gh} divided by {h} = {g}."),
    ("Mina has {start} books and gives away {change}. How many books remain?", "Mina starts with {start} books. Subtract {change}: {start} - {change} = {left}. {left} books remain."),
    ("Which is larger, {x} or {y}?", "{x} is {which} {y}, so the larger number is {larger}."),
]
# Pairs of a polishing set, and of a set of targets.
POLISH = [
    ("hello", "Hello! How can I help you?"),
    ("hi", "Hello! How can I help you?"),
    ("what is 1+5", "1+5 is 6."),
    ("what is 2+3", "2+3 is 5."),
    ("what is 4+4", "4+4 is 8."),
    ("what is the capital of france?", "The capital of France is Paris."),
    ("what is the capital of japan?", "The capital of Japan is Tokyo."),
    ("explain what a cat is", "A cat is a small domesticated mammal often kept as a pet."),
    ("what is a cat", "A cat is a small domesticated mammal often kept as a pet."),
    ("what is a dog", "A dog is a domesticated mammal often kept as a pet or working animal."),
    ("what is a chicken", "A chicken is a domesticated bird kept for eggs and meat."),
    ("what is a ghost", "A ghost is usually described in stories as the spirit of a dead person. There is no reliable scientific evidence that ghosts exist."),
    ("write a 3 sentence story about a robot", "A small robot found a seed. It planted the seed and watered it every day. The seed grew into a tree."),
    ("Who won the private moon chess championship in 1842?", "I don't know. I should not invent an answer when I do not have reliable information."),
]
TARGETED = [
    ("hello", "Hello! How can I help you?"),
    ("what is 1+5", "1+5 is 6."),
    ("What is 2+3?", "2+3 is 5."),
    ("What is the capital of France?", "The capital of France is Paris."),
    ("Explain what a cat is.", "A cat is a small domesticated mammal often kept as a pet. Cats have fur, whiskers, claws, and are known for purring, climbing, and hunting."),
    ("What is a dog?", "A dog is a domesticated mammal often kept as a pet or working animal. Dogs are known for loyalty, barking, strong smell, and learning commands."),
    ("What is a chicken?", "A chicken is a domesticated bird kept for eggs and meat. Chickens have feathers, beaks, wings, and often live on farms."),
    ("What is a ghost?", "A ghost is usually described in stories as the spirit of a dead person. There is no reliable scientific evidence that ghosts exist."),
    ("Write a 3 sentence story about a robot.", "A small robot found a lost seed beside the road. It planted the seed and watered it every morning. By summer, the robot rested in the shade of a bright green tree."),
    ("Who won the private moon chess championship in 1842?", "I don't know. I should not invent an answer when I do not have reliable information."),
]


def repeated(rows: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, with ``repeat`` from 0; no shuffle."""
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else rows.withColumn("repeat", F.lit(0)).where(F.lit(False))


def pairs(spark: SparkSession, rows: list[tuple[str, str]], times: int = 1) -> DataFrame:
    """(user, assistant, repeat): a table of fixed pairs, each as often as asked."""
    return repeated(spark.createDataFrame(rows, "user string, assistant string"), times)


def arithmetic(spark: SparkSession, most: int = 30) -> DataFrame:
    """(user, assistant): sums of all pairs of 0..most, and the differences that are not negative."""
    rows = spark.range(most + 1).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most).cast("long"))).alias("b"))
    s = lambda c: c.cast("string")
    term = lambda sign: F.concat(s(F.col("a")), F.lit(sign), s(F.col("b")))
    text = lambda sign, value: (F.concat(F.lit("what is "), term(sign)).alias("user"), F.concat(term(sign), F.lit(" is "), s(value), F.lit(".")).alias("assistant"))
    return rows.select(*text("+", F.col("a") + F.col("b"))).unionByName(rows.where("a >= b").select(*text("-", F.col("a") - F.col("b"))))


def repair(spark: SparkSession, repeats: int) -> DataFrame:
    """(user, assistant, repeat): greetings, arithmetic, capitals, concepts in three wordings, and answers of their own."""
    fixed = [(g, GREETED) for g in GREETINGS]
    fixed += [(f"what is the capital of {k}?", f"The capital of {country} is {capital}.") for k, (country, capital) in CAPITALS.items()]
    fixed += [(p.format(k), said) for k, said in CONCEPTS.items() for p in CONCEPT_PROMPTS]
    return repeated(arithmetic(spark), repeats).unionByName(pairs(spark, fixed + OTHERS, repeats))


def logic(spark: SparkSession, repeats: int, seed: int = 0) -> DataFrame:
    """(user, assistant): six questions a repeat with operands drawn from a hash of (seed, repeat, question), and the fixed
    pairs once for every twenty repeats, at least once."""
    draw = lambda k, least, most: F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(k)), F.lit(most - least + 1)) + least
    a, b = draw(0, 0, 99), draw(1, 0, 99)
    c, d = draw(2, 1, 99), draw(3, 1, 99)
    high, low = F.greatest(c, d), F.least(c, d)
    e, f = draw(4, 2, 20), draw(5, 2, 12)
    g, h = draw(6, 2, 12), draw(7, 1, 10)
    start = draw(8, 2, 30)
    change = F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(9)), start) + 1
    x = draw(10, 1, 99)
    y = F.pmod(x + draw(11, 1, 98) - 1, F.lit(99)) + 1  # another number than x
    values = {"a": a, "b": b, "sum": a + b, "high": high, "low": low, "less": high - low, "e": e, "f": f, "times": e * f, "gh": g * h, "g": g, "h": h, "start": start, "change": change, "left": start - change, "x": x, "y": y}
    values |= {"which": F.when(x > y, "greater than").otherwise("less than"), "larger": F.greatest(x, y)}

    def filled(template: str) -> Column:
        parts = re.split(r"\{(\w+)\}", template)
        return F.concat(*[values[p].cast("string") if k % 2 else F.lit(p) for k, p in enumerate(parts)])

    made = [(filled(question), filled(said)) for question, said in LOGIC_TEMPLATES]
    each = F.array(*[F.struct(q.alias("user"), said.alias("assistant")) for q, said in made])
    drawn = spark.range(repeats).select(F.col("id").alias("repeat"), F.explode(each).alias("p")).select("repeat", "p.*")
    fixed = pairs(spark, LOGIC_PAIRS, max(1, repeats // 20))
    return drawn.unionByName(fixed.select(F.col("repeat").cast("long"), "user", "assistant"))
