"""Quality rules as a ledger of bit masks.

Every rule is evaluated once for each text. The ledger keeps the measurements and one integer whose bits say which
rules failed. A policy is a version name and a mask of the bits that matter, so policies are applied, compared and
ablated by bitwise work on the ledger, without reading a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Fixed: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_letters"]


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` holds for the measurements (a SQL condition)."""

    name: str
    fails: str


#: Bit i of a ledger is rule i; new rules go at the end.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("upper_case", "10 * n_upper > 7 * n_letters and n_letters > 0"),
)
#: Versions of the policy: the rules whose failure rejects a document.
POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "upper_case"),
}


def mask(names: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    places = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << places[n] for n in names)


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of a text; all 0 for null. Lines count if they have a word; letters are A-Z and a-z."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    spaces = int(of[0x20] + of[0x09:0x0E].sum())
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    upper = int(of[ord("A") : ord("Z") + 1].sum())
    letters = upper + int(of[ord("a") : ord("z") + 1].sum())
    return n, len(text) - spaces, int(of[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), len(lines), _repeated(words), upper, letters


def _repeated(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    _, back, counts = np.unique(pairs[:-1] * np.int64(len(ids)) + w[2:], return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, MEASURES (long), failed (the rules' bits, long).

    A null or empty text has measurements of 0 and so fails ``too_few_words``. Null ids and repeated rows are kept; an
    empty table gives an empty ledger; other columns are not read. Whole texts are measured once, with no shuffle.
    """

    def rows(batch: dict[str, list]) -> dict[str, list]:
        made = list(zip(*map(measure, batch["text"]))) or [()] * len(MEASURES)
        return {"doc_id": batch["id"]} | {k: list(v) for k, v in zip(MEASURES, made)}

    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    measured = map_arrow(wanted, rows, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules)]
    failed = F.lit(0)
    for b in bits:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed.cast("long"))


def judged(ledger_rows: DataFrame, version: str = "v1") -> DataFrame:
    """The ledger with ``kept``: whether no rule of the policy failed. A null id stays; bits are never null; no rows give no rows."""
    return ledger_rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(ledger_rows: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: how many documents fail it, fail it alone, and would be kept without it; one row a rule.

    The ledger is first counted by its bits, of which there are at most two to the power of the rules. Rows with a null id
    and repeated rows count as any other; an empty ledger gives an empty result.
    """
    policy = mask(POLICIES[version])
    counts = ledger_rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy)).alias("failed")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask((n,))).cast("long").alias("bit")) for n in POLICIES[version]])
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return (
        counts.select("failed", "n", F.inline(rules))  # a row for each rule of the policy
        .groupBy("rule")
        .agg(
            total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(F.col("failed") == F.col("bit")).alias("n_alone"),
            total(F.col("failed").bitwiseAND(F.lit(policy).bitwiseXOR(F.col("bit"))) == 0).alias("n_kept_without"), total(F.col("failed") == 0).alias("n_kept"),
        )
    )
