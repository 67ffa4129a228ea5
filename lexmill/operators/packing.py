"""Windows over token streams, one-document windows, segments, batches, and chat samples with label masks.

Tokens are arrays of any one type: strings of the white-space tokenizer, or ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the label that a loss leaves out.
IGNORED = -100
#: Fixed text: stands for the part that is cut out of a long answer.
GAP = "\n...\n"


def windows(stream: DataFrame, length: int, ids: str = "ids", extra: int = 0) -> DataFrame:
    """(window, tokens): windows of ``length`` + ``extra`` tokens that start every ``length``; short ones at the end go.

    ``stream`` has ``start``, the place of a row's first token, and its tokens. Rows are cut where windows meet, so what
    is shuffled is one piece for each row and window, never single tokens.
    """
    end = F.col("start") + F.size(ids)
    first = F.greatest(F.floor((F.col("start") - extra) / length), F.lit(0))
    pieces = (
        stream.where(F.size(ids) > 0)
        .withColumn("window", F.explode(F.sequence(first, F.floor((end - 1) / length))))
        .withColumns({"a": F.greatest(F.col("start"), F.col("window") * length), "b": F.least(end, F.col("window") * length + length + extra)})
        .where("b > a")
        .select("window", "a", F.slice(ids, (F.col("a") - F.col("start") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")).alias("piece"))
    )
    whole = pieces.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("a", "piece"))).alias("pieces"))
    return whole.select("window", F.flatten(F.transform("pieces", lambda p: p["piece"])).alias("tokens")).where(F.size("tokens") == length + extra)


def shifted(windows_of: DataFrame, length: int, total: int) -> DataFrame:
    """Windows of ``length`` + 1 tokens as inputs and the next tokens as labels.

    Of a stream of ``total`` tokens there are total // length - 1: the last whole run only lends its first token as a
    label, even where one more token follows it.
    """
    return windows_of.where(F.col("window") < total // length - 1).select("window", F.slice("tokens", 1, length).alias("inputs"), F.slice("tokens", 2, length).alias("labels"))


def one_each(ids: Column, length: int, bos: Column, eos: Column, pad: Column) -> Column:
    """The first ``length`` - 2 tokens between begin and end markers, padded to ``length``."""
    body = F.concat(F.array(bos), F.slice(ids, 1, length - 2), F.array(eos))
    return F.concat(body, F.array_repeat(pad, F.greatest(length - F.size(body), F.lit(0))))


def segments(df: DataFrame, length: int, ids: str = "ids") -> DataFrame:
    """One row for each run of ``length`` - 1 tokens (a begin marker takes a place), the short last one too: seg, tokens."""
    step = length - 1
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / step)), lambda k: F.slice(ids, (k * step + 1).cast("int"), step))
    return df.where(F.size(ids) > 0).select(*[c for c in df.columns if c != ids], F.posexplode(runs).alias("seg", "tokens"))


def batches(df: DataFrame, place: str, size: int, total: int, drop_last: bool = True) -> DataFrame:
    """Rows numbered from 0 by ``place`` with their batch; a short last batch goes if ``drop_last``."""
    out = df.withColumn("batch", F.floor(F.col(place) / size))
    return out.where(F.col("batch") < total // size) if drop_last else out


def padded(tokens: Column, length: Column, pad: Column) -> Column:
    """Tokens padded on the right."""
    return F.concat(tokens, F.array_repeat(pad, (length - F.size(tokens)).cast("int")))


def latest(ids: Column, length: int, bos: Column) -> Column:
    """All tokens after a begin marker, or the latest of them that fit with it."""
    whole = F.concat(F.array(bos), ids)
    return F.when(F.size(whole) <= length, whole).otherwise(F.concat(F.array(bos), F.slice(ids, -(length - 1), length - 1)))


def sample_texts(conversation: Column, target: Column) -> Column:
    """What a sample is encoded from, message by message up to the target: structs (text, labelled).

    An assistant message gives its prefix and its answer apart; blank messages give nothing. The answer of the target
    is labelled, and with a null target the answers of all assistant messages. A target that is no place of the
    conversation, or not an assistant's message, is an error.
    """
    from ..functions.chat import capitalized
    from ..functions.text import strip

    part = lambda text, labelled: F.struct(text.alias("text"), labelled.alias("labelled"))

    def parts(m: Column, i: Column) -> Column:
        content = strip(F.coalesce(m["content"], F.lit("")))
        name = F.when(m["role"] == "user", "User").otherwise(capitalized(m["role"]))
        other = F.array(part(F.concat(name, F.lit(": "), content, F.lit("\n")), F.lit(False)))
        answer = F.array(part(F.lit("Assistant: "), F.lit(False)), part(F.concat(content, F.lit("\n")), target.isNull() | (i == target)))
        return F.when(content == "", F.slice(other, 1, 0)).when(m["role"] == "assistant", answer).otherwise(other)

    said = F.get(conversation, target)["role"]
    wrong = target.isNotNull() & ((target < 0) | (target >= F.size(conversation)) | ~said.eqNullSafe(F.lit("assistant")))
    known = F.when(wrong, F.raise_error(F.concat(F.lit("not a place of an assistant's message: "), target.cast("string")))).otherwise(conversation)
    taken = F.when(target.isNull(), conversation).otherwise(F.slice(known, 1, target + 1))
    return F.flatten(F.transform(taken, parts))


def answered(df: DataFrame, conversation: str = "conversation") -> DataFrame:
    """``df``; raises if it has no conversation with an assistant's answer to learn from."""
    from ..functions.text import non_blank

    some = F.exists(conversation, lambda m: (m["role"] == "assistant") & non_blank(m["content"]).isNotNull())
    if df.where(some).isEmpty():
        raise ValueError("no conversation has an assistant's answer")
    return df


def sample(texts: Column, encoded: Column, bos: Column, eos: Column) -> Column:
    """Structs (token, labelled) of a whole sample. ``encoded``: an array of tokens for each of ``texts``."""
    one = lambda t, on: F.struct(t.alias("token"), on.alias("labelled"))
    body = F.flatten(F.zip_with(texts, encoded, lambda x, ids: F.transform(ids, lambda t: one(t, x["labelled"]))))
    return F.concat(F.array(one(bos, F.lit(False))), body, F.array(one(eos, F.lit(True))))


def target_start(tokens: Column) -> Column:
    """The place, from 0, of the first labelled token."""
    return F.array_position(F.transform(tokens, lambda t: t["labelled"]), True) - 1


def truncated(tokens: Column, length: int, gap: Column, bos: Column) -> Column:
    """A sample cut to ``length`` tokens: the latest of the prompt, and the head and tail of a long answer.

    ``tokens`` are structs (token, labelled) of which all from the first labelled one on are labelled. The prompt
    gives way to the answer down to a third of the length; an answer that still does not fit keeps its head and, after
    ``gap``, its tail; with no room for that, its head and its last token.
    """
    at = target_start(tokens).cast("int")
    n = F.size(tokens)
    answer = n - at
    available = F.greatest(at - 1, F.lit(0))
    prompt = F.least(available, F.greatest(F.least(available, F.lit(length // 3)), length - answer - 1))
    budget = length - prompt - 1
    gaps = F.transform(gap, lambda t: F.struct(t.alias("token"), F.lit(True).alias("labelled")))
    k = F.size(gap)
    tail = F.greatest(F.lit(1), F.least(F.greatest(F.lit(16), F.floor(budget / 4)), F.floor(budget / 2)))
    head = F.greatest(F.lit(1), budget - tail - k)
    rest = F.greatest(F.lit(1), budget - head - k)
    piece = lambda start, size: F.slice(tokens, (start + 1).cast("int"), size.cast("int"))
    with_gap = F.concat(piece(at, head), gaps, piece(n - rest, rest))
    tight = F.concat(piece(at, F.greatest(budget - 1, F.lit(0))), piece(n - 1, F.lit(1)))
    cut = F.when(answer <= budget, piece(at, answer)).when(budget >= k + 2, with_gap).otherwise(tight)
    begin = F.array(F.struct(bos.alias("token"), F.lit(False).alias("labelled")))
    return F.when(n <= length, tokens).otherwise(F.concat(begin, piece(F.greatest(at - prompt, F.lit(1)), at - F.greatest(at - prompt, F.lit(1))), cut))


def cut_right(tokens: Column, length: int) -> Column:
    """The older cut: the first ``length`` tokens."""
    return F.slice(tokens, 1, length)


def tensors(tokens: Column, length: int, pad: Column, ignored: Column) -> Column:
    """A struct of inputs and labels, both of ``length``."""
    ids, labels = F.transform(tokens, lambda t: t["token"]), F.transform(tokens, lambda t: F.when(t["labelled"], t["token"]).otherwise(ignored))
    return F.struct(padded(ids, F.lit(length), pad).alias("inputs"), padded(labels, F.lit(length), ignored).alias("labels"))


def candidate(prompt: list, whole: list, most: int) -> tuple[list, list[bool]]:
    """Ids and the mask of scored places of a candidate: what follows the encodings' common prefix, the latest that fit.

    The first id is never scored. Raises ValueError if nothing is.
    """
    same = next((i for i, (a, b) in enumerate(zip(prompt, whole)) if a != b), min(len(prompt), len(whole)))
    cut = max(0, len(whole) - most)
    ids = whole[cut:]
    mask = [i > 0 and i + cut >= same for i in range(len(ids))]
    if not any(mask):
        raise ValueError("the candidate has no token to score")
    return ids, mask


def candidates(df: DataFrame, encode: Callable[[list[str]], list[list[int]]], most: int) -> DataFrame:
    """``df`` (with prompt and choice) with ids, mask and target_tokens; the choice is put after a space."""
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tails = [c if c.startswith(" ") else " " + c for c in frame["choice"]]
            made = [candidate(a, b, most) for a, b in zip(encode(list(frame["prompt"])), encode([p + t for p, t in zip(frame["prompt"], tails)]))]
            yield frame.assign(ids=[m[0] for m in made], mask=[m[1] for m in made], target_tokens=[sum(m[1]) for m in made])

    from pyspark.sql.types import StructType

    return df.mapInPandas(run, StructType([*df.schema.fields, *StructType.fromDDL("ids array<int>, mask array<boolean>, target_tokens long").fields]))
