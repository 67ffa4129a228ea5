"""Chat messages: a conversation is an array of structs (role, content) in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import collapse, non_blank, strip

# Other names of the two roles, and the roles that a conversation may have.
USER_NAMES, ASSISTANT_NAMES = ("human", "prompter"), ("gpt", "bot")
ROLES = ("user", "assistant", "system")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, conversation) from rows (conv_id, turn, role, text)."""
    row = F.struct("turn", "role", F.col("text").alias("content"))
    ordered = F.array_sort(F.collect_list(row))
    return turns.groupBy("conv_id").agg(ordered.alias("turns")).select("conv_id", F.transform("turns", lambda m: message(m["role"], m["content"])).alias("conversation"))


def message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def canonical_role(role: Column, exact: bool = False) -> Column:
    """user, assistant, or the role itself; lower-cased and stripped first unless ``exact``."""
    r = role if exact else F.lower(strip(role))
    return F.when(r.isin(*USER_NAMES), "user").when(r.isin(*ASSISTANT_NAMES), "assistant").otherwise(r)


def canonical(conversation: Column, exact: bool = False) -> Column:
    """Canonical roles and stripped contents; messages without content go."""
    made = F.transform(conversation, lambda m: message(canonical_role(m["role"], exact), strip(F.coalesce(m["content"], F.lit("")))))
    return F.filter(made, lambda m: m["content"] != "")


def broad(conversation: Column) -> Column:
    """As ``canonical``, with only the known roles; null without a user or without an assistant."""
    kept = F.filter(canonical(conversation), lambda m: m["role"].isin(*ROLES))
    return F.when(valid(kept), kept)


def has(conversation: Column, role: str) -> Column:
    return F.exists(conversation, lambda m: (m["role"] == role) & non_blank(m["content"]).isNotNull())


def valid(conversation: Column) -> Column:
    """At least one user and one assistant message that are not blank."""
    return has(conversation, "user") & has(conversation, "assistant")


def writable(conversation: Column) -> Column:
    """The messages of known roles with content, if there are two or more and one is an assistant's; else null."""
    kept = F.filter(conversation, lambda m: m["role"].isin(*ROLES) & non_blank(m["content"]).isNotNull())
    return F.when((F.size(kept) >= 2) & F.exists(kept, lambda m: m["role"] == "assistant"), kept)


def first_turns(conversation: Column, n: int = 8) -> Column:
    """The first n messages of user and assistant, if there are two or more; else null."""
    two = F.filter(conversation, lambda m: m["role"].isin("user", "assistant"))
    return F.when(F.size(two) >= 2, F.slice(two, 1, n))


def pair(user: Column, assistant: Column, stripped: bool = True) -> Column:
    """A conversation of one question and one answer."""
    f = strip if stripped else (lambda c: c)
    return F.array(message(F.lit("user"), f(user)), message(F.lit("assistant"), f(assistant)))


def with_context(instruction: Column, context: Column, title: str) -> Column:
    """The instruction with a titled context below it, where there is one."""
    return F.when(non_blank(context).isNull(), instruction).otherwise(F.concat(instruction, F.lit(f"\n\n{title}:\n"), context))


def canonical_json(conversation: Column, collapsed: bool = True) -> Column:
    """Compact JSON with sorted keys, of contents with white space collapsed (else stripped)."""
    clean = collapse if collapsed else strip
    text = F.to_json(F.transform(conversation, lambda m: F.struct(clean(m["content"]).alias("content"), m["role"].alias("role"))))
    for c in "BCEF":  # control characters are escaped with small letters
        text = F.replace(text, F.lit(f"\\u000{c}"), F.lit(f"\\u000{c.lower()}"))
        text = F.replace(text, F.lit(f"\\u001{c}"), F.lit(f"\\u001{c.lower()}"))
    for c in "AD":
        text = F.replace(text, F.lit(f"\\u001{c}"), F.lit(f"\\u001{c.lower()}"))
    return text


def identity(conversation: Column) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(conversation), 256)


def capitalized(role: Column) -> Column:
    """First letter large, the others small."""
    return F.concat(F.upper(F.left(role, F.lit(1))), F.lower(F.substring(role, F.lit(2), F.length(role))))


def flat_text(conversation: Column) -> Column:
    """``Role: content`` lines between the two literal markers."""
    lines = F.transform(conversation, lambda m: F.concat(capitalized(m["role"]), F.lit(": "), m["content"]))
    return F.array_join(F.concat(F.array(F.lit("<bos>")), lines, F.array(F.lit("<eos>"))), "\n")


def prompt(history: Column, user: Column) -> Column:
    """The turns so far, the new question, and an open answer; ``history`` has structs (user, assistant)."""
    past = F.flatten(F.transform(history, lambda t: F.array(F.concat(F.lit("User: "), t["user"]), F.concat(F.lit("Assistant: "), t["assistant"]))))
    return F.array_join(F.concat(past, F.array(F.concat(F.lit("User: "), user), F.lit("Assistant: "))), "\n")


def fitting_history(messages: Column, context: int, cost) -> Column:
    """The latest messages whose ``cost`` in all is below ``context``, in steps of the two oldest; at least the last one."""
    n = F.size(messages)
    total = lambda k: F.aggregate(F.slice(messages, k + 1, F.greatest(n - k, F.lit(1))), F.lit(0), lambda s, m: s + cost(m))
    steps = F.filter(F.sequence(F.lit(0), n - 1), lambda k: ((k % 2 == 0) | (k == n - 1)) & (total(k) < context))
    first = F.coalesce(F.get(steps, F.lit(0)), n - 1)
    return F.slice(messages, first + 1, n - first)


#: What ends a reply, in the order in which it is looked for.
STOPS = ("<eos>", "<pad>", "<bos>", "\nUser:", "\nAssistant:")


def clean_reply(text: Column, stops: tuple[str, ...] = STOPS) -> Column:
    """Cut at the first place of each marker in turn, stripped."""
    for stop in stops:
        text = F.substring_index(text, stop, 1)
    return strip(text)
