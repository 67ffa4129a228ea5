"""Text columns: Unicode white space as Python sees it, extraction from candidate fields, truncation, n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The code points that str.strip() and str.split() treat as white space. In the class those below 256 stand
# one by one, as Java looks such up in a table.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\x{09}\x{0a}\x{0b}\x{0c}\x{0d}\x{1c}\x{1d}\x{1e}\x{1f}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: What ``words`` gives one item for.
WORD = f"[^{SPACE[1:]}+"
#: Characters below which a document is dropped.
LEAST_CHARS = 80


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    # a single space that no white space precedes stays as it is and is not looked at
    return F.regexp_replace(strip(text), f"[{SPACE[1:-1].replace(chr(92) + 'x{20}', '')}]{SPACE}*| {SPACE}+", " ")


def words(text: Column) -> Column:
    """The text split at white space; an empty array for an empty or null text."""
    return F.array_remove(F.split(strip(F.coalesce(text, F.lit(""))), f"{SPACE}+"), "")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once, where a filter on them would else repeat them below itself."""
    for name, value in columns.items():
        rest = [c for c in df.columns if c != name]
        df = df.select(*rest, F.explode(F.array(value)).alias(name))
    return df


def non_blank(text: Column) -> Column:
    """The stripped text, or null if nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def first_long(fields: Sequence[Column], least: int = LEAST_CHARS) -> Column:
    """The first field with at least ``least`` characters once stripped; else empty."""
    kept = [F.when(F.length(strip(c)) >= least, strip(c)) for c in fields]
    return F.coalesce(*kept, F.lit(""))


def first_non_blank(fields: Sequence[Column]) -> Column:
    """The first field that is not blank, however short; else empty."""
    return F.coalesce(*map(non_blank, fields), F.lit(""))


def named_or_first(named: Column, fields: Sequence[Column]) -> Column:
    """The named field if it is there at all, even when blank; else the first non-blank of the others."""
    return F.when(named.isNotNull(), strip(named)).otherwise(first_non_blank(fields))


def all_joined(fields: Sequence[Column], others: Sequence[Column] = (), least_other: int = 200) -> Column:
    """Every non-blank field, a blank line between them; if there is none, the first other field longer than ``least_other``."""
    other = F.coalesce(*[F.when(F.length(c) > least_other, c) for c in others], F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws("\n\n", *map(non_blank, fields)), F.lit("")), other)


def normalized(text: Column, most: int | None = None) -> Column:
    """NUL as a space, white space collapsed; cut to ``most`` characters."""
    out = collapse(F.replace(text, F.lit("\0"), F.lit(" ")))
    return out if most is None else F.substring(out, 1, most)


def corpus_line(text: Column) -> Column:
    """A line of a tokenizer's corpus: NUL as a space and a newline at the end."""
    return F.concat(F.replace(text, F.lit("\0"), F.lit(" ")), F.lit("\n"))


def one_line(text: Column) -> Column:
    """Newlines as spaces."""
    return F.replace(text, F.lit("\n"), F.lit(" "))


def utf8_cut(text: Column, size: Column) -> Column:
    """The longest prefix of whole characters that has at most ``size`` UTF-8 bytes."""
    raw = F.encode(text, "UTF-8")
    # a byte 80..BF continues a character: step back over up to three of them
    follows = lambda k: F.hex(F.substring(raw, size - k + 1, F.lit(1))).between("80", "BF")
    back = F.when(~follows(0), 0).when(~follows(1), 1).when(~follows(2), 2).otherwise(3)
    cut = F.decode(F.substring(raw, F.lit(1), (size - back).cast("int")), "UTF-8")
    return F.when(F.octet_length(text) <= size, text).when(size <= 0, F.lit("")).otherwise(cut)


def grams(text: Column, n: int = 13, hashed: bool = False) -> Column:
    """The distinct n-grams of runs of a-z and 0-9 in the lower-cased text, joined by spaces; none for fewer than n words.

    ``hashed``: as 64-bit hashes of the words instead (``gram_hash`` gives that of a joined n-gram).
    """
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)

    def made(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: i <= F.size(w) - n + 1)
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, n)) if hashed else F.array_join(F.slice(w, i, n), " ")))

    return F.element_at(F.transform(F.array(found), made), 1)  # the words are found once, not for each n-gram


def gram_hash(gram: Column) -> Column:
    return F.xxhash64(F.split(gram, " "))


def duration(seconds: Column) -> Column:
    """Seconds as days, hours and minutes, from the greatest unit that is not 0; ``not available`` for null."""
    s = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    days, hours, minutes = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60
    unit = lambda n, name: F.concat(n.cast("string"), F.lit(name))
    return (
        F.when(seconds.isNull(), "not available")
        .when(days > 0, F.concat_ws(" ", unit(days, "d"), unit(hours, "h"), unit(minutes, "m")))
        .when(hours > 0, F.concat_ws(" ", unit(hours, "h"), unit(minutes, "m")))
        .otherwise(unit(minutes, "m"))
    )


def learning_rate(step: Column, total: int, peak: float, warmup: int) -> Column:
    """Linear warm-up to ``peak`` through step ``warmup``, then half a cosine wave down to a tenth of it at ``total``."""
    done = F.least((step - warmup) / max(1, total - warmup), F.lit(1.0))
    falling = peak * (0.1 + 0.45 * (1 + F.cos(F.pi() * done)))
    return F.when(step <= warmup, peak * step / warmup).otherwise(falling) if warmup else falling
