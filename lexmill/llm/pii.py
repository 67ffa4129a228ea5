"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in Spark's own functions.

Values are found by one regular expression and validated (check digit, octets, calendar). A value is permuted within
its format by ten Feistel rounds, keyed by SHA-256: a card number becomes another with a right check digit, a date
another date, an address another address. The map is one to one for a key, so equal values stay linked across
documents and different ones stay apart. No Python runs on the executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 10
#: Days of the 400-year cycle that starts on 1 January 1700: 189 * 773.
CYCLE_START, CYCLE = "1700-01-01", (189, 773)

# Fixed formats (Java regular expressions). An earlier kind is tried first at a place. Values of any length are taken whole:
# what has no length of its own is a run of a class, which Java matches without recursion, from the run's start or from where the last value ended.
KEY_NAME = r"""(?i:token|password|passwd|secret|api[_-]?key)\s*+[=:]\s*+["']?+"""
KEY_VALUE = r"""[^\s"'<>,;]*[\p{L}\p{N}]"""
MAIL = r"[\p{L}\p{N}._%+-]"
#: Lengths of bank account numbers by country.
IBAN = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "ES": 24, "FR": 27, "GB": 22, "IT": 27, "LU": 20, "NL": 18, "PT": 25}
HEX = "[0-9A-Fa-f]{1,4}"


def _iban(country: str, length: int) -> str:
    fours, rest = divmod(length - 4, 4)
    return rf"{country}\d{{2}}" + r"(?: ?[A-Z0-9]{4})" + f"{{{fours}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


KINDS = {
    "named_key": rf"""{KEY_NAME}(?:(?<==\s{{0,3}}["']?){KEY_VALUE}|[A-Za-z0-9_/+-]{{12,}}+|(?=[^\s\d"'<>,;]*+\d){KEY_VALUE})""",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "email": rf"(?:(?<!{MAIL})|\G){MAIL}++@(?=[\p{{L}}\p{{N}}])[\p{{L}}\p{{N}}.-]*\.\p{{L}}{{2,}}+",
    "iban": r"\b(?:" + "|".join(_iban(c, n) for c, n in IBAN.items()) + r")\b",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\d.])\d{3}\.\d{3}\.\d{4}(?!\d|\.\d)",
    "world_phone": r"\+[1-9]\d{0,2}(?:[ ./-]?\(?\d{1,4}\)?){2,6}(?!\d)|(?<![\d.])0[1-9](?:([ .-]?)\d{2})(?:\1\d{2}){3}(?![\d.])|(?<!\d)(?:\(0\d{2,4}\)|0\d{2,4})(?: ?[/-] ?| )\d{3,4}[ -]?\d{3,5}(?!\d)",
    "iso_date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "dotted_date": r"(?<![\d.])\d{2}\.\d{2}\.\d{4}(?!\d|\.\d)",
    "slashed_date": r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "ipv6": rf"(?<![\w:.])(?:(?:{HEX}:){{7}}{HEX}|(?=[A-Fa-f:]*+\d)(?:{HEX}(?::{HEX}){{0,5}})?::(?:{HEX}(?::{HEX}){{0,5}})?)(?![\w:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4} \d{4}|\d{13,19})(?!\d)",
}
#: Ranges within which letters are permuted; those of other scripts stay as they are.
LETTERS = (("a", "z"), ("A", "Z"), ("à", "ö"), ("À", "Ö"), ("ø", "þ"), ("Ø", "Þ"))
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def _prf(key: str, *parts: Column) -> Column:
    """60 bits of the keyed hash of the parts."""
    text = F.concat_ws(":", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def permuted_pair(key: str, kind: str, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """A keyed permutation of the pairs (a, b) with a < size_a and b < size_b, as a struct of both."""

    def step(pair: Column, i: Column) -> Column:
        x, y = pair["a"], pair["b"]
        even = i % 2 == 0
        added = _prf(key, F.lit(kind), i, size_a, size_b, F.when(even, y).otherwise(x))
        return F.struct(F.when(even, F.pmod(x + added, size_a)).otherwise(x).alias("a"), F.when(even, y).otherwise(F.pmod(y + added, size_b)).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """A keyed permutation of the strings of as many digits (2 to 18)."""
    n = F.length(digits)
    left, right = (n / 2).cast("int"), n - (n / 2).cast("int")
    size = lambda k: F.pow(F.lit(10), k).cast("long")
    pair = permuted_pair(key, kind, F.substring(digits, F.lit(1), left), F.substring(digits, left + 1, right), size(left), size(right))
    return _let(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), right, "0")))


def permuted_text(key: str, kind: str, text: Column, letters: tuple[tuple[str, str], ...] = LETTERS) -> Column:
    """A keyed permutation of texts that keeps each character's class: digit, a range of ``letters``, or itself.

    Texts that differ only in the case of letters become texts that differ only in that.
    """
    n = F.length(text)
    half = (n / 2).cast("int")

    def moved(target: Column, source: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), F.length(target).cast("string"), F.lower(source)), 512)

        def one(c: Column, by: Column) -> Column:
            turned = lambda first, size: F.char(F.lit(ord(first)) + F.pmod(F.ascii(c) - ord(first) + by, F.lit(size)))
            out = F.when(c.between("0", "9"), turned("0", 10))
            for first, last in letters:
                out = out.when(c.between(first, last), turned(first, ord(last) - ord(first) + 1))
            return out.otherwise(c)

        at = lambda h, j: F.conv(F.substring(h, F.pmod(j - 1, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(target), F.lit(1))), lambda j: j <= F.length(target))
        return _let(stream, lambda h: F.array_join(F.transform(places, lambda j: one(F.substring(target, j, F.lit(1)), at(h, j))), ""))

    def step(pair: Column, i: Column) -> Column:
        even = i % 2 == 0
        new = moved(F.when(even, pair["a"]).otherwise(pair["b"]), F.when(even, pair["b"]).otherwise(pair["a"]), i)
        return _let(new, lambda v: F.struct(F.when(even, v).otherwise(pair["a"]).alias("a"), F.when(even, pair["b"]).otherwise(v).alias("b")))

    whole = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, n).alias("b")), step)
    return _let(whole, lambda p: F.concat(p["a"], p["b"]))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _in_format(x: Column, digits: Column, kind: str = "0-9") -> Column:
    """x with its digits, or the characters of another class, replaced in order by those given."""
    place = lambda i: F.length(F.regexp_replace(F.substring(x, F.lit(1), i), f"[^{kind}]", ""))
    one = lambda i: F.when(F.substring(x, i, F.lit(1)).rlike(f"[{kind}]"), F.substring(digits, place(i), F.lit(1))).otherwise(F.substring(x, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), one), "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits from the right, those at places of parity ``doubled`` doubled, with the digits of each product added."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _card(key: str, x: Column) -> Column:
    def valid(digits: Column) -> Column:
        payload = permuted_digits(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
        whole = _let(payload, lambda p: F.concat(p, F.pmod(-luhn_sum(p, 1), F.lit(10)).cast("string")))
        return F.when(luhn_sum(digits, 0) % 10 == 0, _let(whole, lambda w: _in_format(x, w))).otherwise(x)

    return _let(_only_digits(x), valid)


def _phone(key: str, x: Column) -> Column:
    """Area code and exchange stay in 200 to 999 if they are in it, else in 000 to 199; the line number is any."""

    def new(d: Column) -> Column:
        number = lambda i, n: F.substring(d, F.length(d) - (10 - i), F.lit(n)).cast("long")
        area, exchange, line = number(1, 3), number(4, 3), number(7, 4)
        least = lambda v: F.when(v >= 200, 200).otherwise(0)
        size = lambda v: F.when(v >= 200, 800).otherwise(200)
        pair = permuted_pair(key, "phone", (area - least(area)) * size(exchange) + exchange - least(exchange), line, size(area) * size(exchange), F.lit(10_000))
        text = lambda v, n: F.lpad(v.cast("bigint").cast("string"), n, "0")
        return _let(pair, lambda p: F.concat(
            F.substring(d, F.lit(1), F.length(d) - 10), text(F.floor(p["a"] / size(exchange)) + least(area), 3), text(p["a"] % size(exchange) + least(exchange), 3), text(p["b"], 4)
        ))

    return _let(_let(_only_digits(x), new), lambda w: _in_format(x, w))


def _world_phone(key: str, x: Column) -> Column:
    """The country's code, or a leading zero and the digit after it, stay; all other digits are permuted. 8 to 15 digits."""
    code = F.regexp_extract(x, r"^\+(\d{1,3})(?!\d)", 1)

    def new(d: Column) -> Column:
        kept = F.when(code != "", F.length(code)).otherwise(2)
        return F.concat(F.substring(d, F.lit(1), kept), permuted_digits(key, "phone", F.substring(d, kept + 1, F.length(d))))

    digits = _only_digits(x)
    return _let(digits, lambda d: F.when(F.length(d).between(8, 15), _let(new(d), lambda w: _in_format(x, w))).otherwise(x))


def rest_97(chars: Column) -> Column:
    """The rest by 97 of the number that digits, and letters as 10 to 35, write."""
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    add = lambda r, i: _let(F.substring(chars, i, F.lit(1)), lambda c: (r * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(chars)), F.lit(0), add)


def _bank_account(key: str, x: Column) -> Column:
    """An IBAN whose check digits are right becomes another such one of its country."""
    check = lambda country, number: F.lpad((F.lit(98) - rest_97(F.concat(number, country, F.lit("00")))).cast("string"), 2, "0")

    def new(plain: Column) -> Column:
        country, number = F.substring(plain, F.lit(1), F.lit(2)), F.substring(plain, F.lit(5), F.length(plain))
        made = _let(permuted_text(key, "iban", number, (("A", "Z"),)), lambda n: F.concat(country, check(country, n), n))
        return F.when(F.substring(plain, F.lit(3), F.lit(2)) == check(country, number), _let(made, lambda w: _in_format(x, w, "A-Z0-9"))).otherwise(x)

    return _let(F.replace(x, F.lit(" "), F.lit("")), new)


def _ssn(key: str, x: Column) -> Column:
    """Areas 001 to 899 but 666, groups from 01 and serial numbers from 0001 are numbered, and the numbers permuted."""
    part = lambda i, n: F.substring(x, F.lit(i), F.lit(n)).cast("long")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    pair = permuted_pair(key, "ssn", area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    text = lambda v, n: F.lpad(v.cast("bigint").cast("string"), n, "0")
    new = lambda p: F.concat_ws("-", text(p["a"] + 1 + (p["a"] >= 665).cast("int"), 3), text(F.floor(p["b"] / 9999) + 1, 2), text(p["b"] % 9999 + 1, 4))
    return F.when(x.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"), _let(pair, new)).otherwise(x)


def _ip(key: str, x: Column) -> Column:
    octet = lambda parts, i: F.element_at(parts, i).cast("int")
    halves = lambda p: permuted_pair(key, "ip", octet(p, 1) * 256 + octet(p, 2), octet(p, 3) * 256 + octet(p, 4), F.lit(65536), F.lit(65536))
    text = lambda v: F.concat_ws(".", *[o.cast("string") for h in (v["a"], v["b"]) for o in (F.floor(h / 256), h % 256)])
    new = lambda p: _let(halves(p), text)
    return _let(F.split(x, r"\."), lambda p: F.when(F.forall(p, lambda o: o.cast("int") < 256), new(p)).otherwise(x))


def _date(key: str, x: Column, pattern: str, iso: Column) -> Column:
    days, start = CYCLE[0] * CYCLE[1], F.lit(CYCLE_START).cast("date")
    a, b = (F.lit(s).cast("long") for s in CYCLE)

    def moved(n: Column) -> Column:
        pair = permuted_pair(key, "date", F.floor(n / CYCLE[1]), n % CYCLE[1], a, b)
        new = _let(pair, lambda p: F.date_format(F.date_add(start, (p["a"] * CYCLE[1] + p["b"]).cast("int")), pattern))
        return F.when((n >= 0) & (n < days), new).otherwise(x)

    return F.coalesce(_let(F.datediff(iso.try_cast("date"), start), moved), x)


def _slashed_date(key: str, x: Column) -> Column:
    """Month first where that is a date, else day first.

    A date that can only be day first becomes another such one, so the map stays one to one: it is permuted again until
    its day is above 12 (a chance of 0.6 each time, 64 times at most).
    """
    part = lambda i, n: F.substring(x, F.lit(i), F.lit(n))
    month_first, day_first = (F.concat_ws("-", part(7, 4), part(i, 2), part(j, 2)) for i, j in ((1, 4), (4, 1)))
    days, start = CYCLE[0] * CYCLE[1], F.lit(CYCLE_START).cast("date")
    a, b = (F.lit(s).cast("long") for s in CYCLE)
    date = lambda n: F.date_add(start, n.cast("int"))
    next_of = lambda n: _let(permuted_pair(key, "date", F.floor(n / CYCLE[1]), n % CYCLE[1], a, b), lambda p: p["a"] * CYCLE[1] + p["b"])
    walked = lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(63)), next_of(n), lambda v, _: F.when(F.dayofmonth(date(v)) > 12, v).otherwise(next_of(v)))
    moved = lambda n: F.when((n >= 0) & (n < days), F.date_format(date(walked(n)), "dd/MM/yyyy")).otherwise(x)
    other = F.coalesce(_let(F.datediff(day_first.try_cast("date"), start).cast("long"), moved), x)
    return F.when(month_first.try_cast("date").isNotNull(), _date(key, x, "MM/dd/yyyy", month_first)).otherwise(other)


def _email(key: str, x: Column) -> Column:
    dot = F.length(x) - F.length(F.substring_index(x, ".", -1))
    return F.concat(permuted_text(key, "email", F.substring(x, F.lit(1), dot - 1)), F.substring(x, dot, F.length(x)))


def _named_key(key: str, x: Column) -> Column:
    name = F.regexp_extract(x, f"^({KEY_NAME})", 1)
    return F.concat(name, permuted_text(key, "key", F.substring(x, F.length(name) + 1, F.length(x))))


def pseudonym(x: Column, key: str) -> Column:
    """What a found value becomes; itself if it is not valid in its format."""
    is_kind = lambda name: x.rlike(f"^(?:{KINDS[name]})$")
    part = lambda i, n: F.substring(x, F.lit(i), F.lit(n))
    return (
        F.when(is_kind("named_key"), _named_key(key, x))
        .when(is_kind("access_key"), F.concat(F.lit("AKIA"), permuted_text(key, "access", F.substring(x, F.lit(5), F.lit(16)))))
        .when(is_kind("email"), _email(key, x))
        .when(is_kind("iban"), _bank_account(key, x))
        .when(is_kind("phone"), _phone(key, x))
        .when(is_kind("world_phone"), _world_phone(key, x))
        .when(is_kind("iso_date"), _date(key, x, "yyyy-MM-dd", x))
        .when(is_kind("dotted_date"), _date(key, x, "dd.MM.yyyy", F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2))))
        .when(is_kind("slashed_date"), _slashed_date(key, x))
        .when(is_kind("ip"), _ip(key, x))
        .when(is_kind("ipv6"), permuted_text(key, "ipv6", x, (("a", "f"), ("A", "F"))))
        .when(is_kind("ssn"), _ssn(key, x))
        .when(is_kind("card"), _card(key, x))
        .otherwise(x)
    )


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_values") -> DataFrame:
    """The rows of ``docs`` with personal data in the text replaced, and in ``count_col`` how many values were.

    Cards (Luhn), phone numbers (North American with -, ., spaces or brackets; with + and a country's code, 8 to 15 digits;
    with a leading zero in groups of two, or with an area code set off), IBANs of the countries in ``IBAN`` (check digits), IPv4 and IPv6
    addresses, dates from 1700 to 2099 (yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy, dd/mm/yyyy where that is none), US social security
    numbers, e-mail addresses of any length, access keys, and values of named keys (of any length after =; after a colon with a digit or
    12 characters) are replaced; numbers that fail their check stay as they are. Digits and letters of a value are what is replaced. A clean document that names a day, a version like an address or a telephone number of a firm is altered too:
    the formats do not tell whose they are. A null text stays null with a count of 0; an empty one stays empty. All other
    columns and rows, repeated ones too, pass through; a column named ``count_col`` is replaced, one that clashes with a
    helper's name is kept. Whole texts are searched, in one pass with no shuffle. An empty table gives an empty one.

    What plans show is a digest of ``key``. Who reads a plan can so make the same pseudonyms, but does not learn the key.
    """
    key = hashlib.sha256(b"pseudonyms:" + key.encode()).hexdigest()
    names = fresh(docs, "found"), fresh(docs, "new")
    text = F.col(text_col)
    found = F.when(text.rlike("[0-9@=:]"), F.regexp_extract_all(text, F.lit(ANY), 0))
    some = F.size(names[0]) > 0
    new = F.transform(names[0], lambda x: pseudonym(x, key))
    pieces = F.zip_with(F.split(text, ANY), F.concat(names[1], F.array(F.lit(""))), lambda gap, value: F.concat(gap, value))
    count = F.size(F.filter(F.zip_with(names[0], names[1], lambda a, b: a != b), lambda differs: differs))
    return (
        docs.withColumn(names[0], found).withColumn(names[1], F.when(some, new))
        .withColumns({text_col: F.when(some, F.array_join(pieces, "")).otherwise(text), count_col: F.when(some, count).otherwise(0).cast("long")})
        .drop(*names)
    )
