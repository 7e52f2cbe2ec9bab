"""Replace personal data by format-preserving pseudonyms from a keyed Feistel network.

Found values are validated first (Luhn, calendar, octets, mod 97, number plans)
and then permuted within their format, so that the pseudonym is valid too,
equal values stay equal across documents, and two values of one format never
meet (a month-first date can meet a day-first one). Numbers
and dates are indexed into a domain a x b and pass through ``ROUNDS`` rounds of
``left += f(right) mod a`` and ``right += f(left) mod b``; letters and digits of
e-mail names and account numbers shift inside their class by the same scheme.
Only DataFrame expressions run; nothing is shuffled.

Rows: one per input row. A null text stays null, an empty one empty; values
that fail validation stay as they are; repeated rows are each answered; an
empty table gives an empty result. Other columns are kept; ``text`` is replaced
and ``found`` (the kinds in order of appearance) added or replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: 200 years of days from 1900-01-01 on: 73,049 = 17 * 4,297.
FIRST_DAY, DAY_A, DAY_B = "1900-01-01", 17, 4297

PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "iso_date": r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "day_date": r"(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1(?:19|20)[0-9]{2}(?![0-9/]|\.[0-9])",
    "phone": (
        r"(?<![0-9+])\+(?:1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
        r"|[2-9][0-9]{0,2}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3})(?![0-9])"
        r"|(?<![0-9+(.-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}(?![0-9.-][0-9]|[0-9])"
    ),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(PATTERNS.values())


def _mix(secret: str, kind: str, i: Column, x: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(secret), F.lit(kind), i.cast("string"), x.cast("string")), 256)


def feistel(value: Column, a: Column, b: Column, secret: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1."""

    def step(s: Column, i: Column) -> Column:
        def f(x: Column) -> Column:
            return F.conv(F.substring(_mix(secret, kind, i, x), 1, 15), 16, 10).cast("long")

        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + f(s["r"])) % a).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + f(s["l"])) % b).alias("r"),
        )

    begin = F.struct(((value - value % b) / b).cast("long").alias("l"), (value % b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step, lambda s: s["l"] * b + s["r"])


def feistel_text(value: Column, secret: str, kind: str) -> Column:
    """A keyed permutation of strings that keeps each character's class: digit, lower or upper case, other."""

    def shift(x: Column, digest: Column) -> Column:
        def one(j: Column) -> Column:
            c = F.ascii(F.substr(x, j, F.lit(1)))
            k = F.conv(F.substr(digest, (j - 1) % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
            moved = (
                F.when(c.between(48, 57), (c - 48 + k) % 10 + 48)
                .when(c.between(97, 122), (c - 97 + k) % 26 + 97)
                .when(c.between(65, 90), (c - 65 + k) % 26 + 65)
            )
            return F.when(moved.isNotNull(), F.chr(moved)).otherwise(F.substr(x, j, F.lit(1)))

        return F.when(F.length(x) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), one), "")).otherwise("")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, shift(s["l"], _mix(secret, kind, i, s["r"]))).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(shift(s["r"], _mix(secret, kind, i, s["l"]))).alias("r"),
        )

    half = F.floor(F.length(value) / 2).cast("int")
    begin = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1, F.length(value)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step, lambda s: F.concat(s["l"], s["r"]))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10), n).cast("long")


def _refill(pattern: Column, fresh: Column, wanted: str = "[0-9]") -> Column:
    """Put the characters of ``fresh`` in place of those of ``pattern`` that match ``wanted``."""

    def step(s: Column, i: Column) -> Column:
        c = F.substr(pattern, i, F.lit(1))
        hit = c.rlike(wanted)
        return F.struct(
            F.concat(s["out"], F.when(hit, F.substr(fresh, s["k"], F.lit(1))).otherwise(c)).alias("out"),
            F.when(hit, s["k"] + 1).otherwise(s["k"]).alias("k"),
        )

    begin = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.length(pattern)), begin, step, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""

    def step(a: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        double = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return (a + F.when(i % 2 == 0, double).otherwise(d)) % 10

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)


def _mod97(text: Column) -> Column:
    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substr(text, i, F.lit(1)))
        return F.when(c <= 57, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def _card(x: Column, secret: str) -> Column:
    d = _digits(x)
    body = F.length(d) - 1
    low = F.floor(body / 2).cast("int")
    moved = feistel(F.substr(d, F.lit(1), body).cast("long"), _ten(body - low), _ten(low), secret, "card")
    fresh = F.lpad(moved.cast("string"), body, F.lit("0"))
    check = (10 - _luhn(F.concat(fresh, F.lit("0")))) % 10
    return F.when(_luhn(d) == 0, _refill(x, F.concat(fresh, check.cast("string"))))


def _phone(x: Column, secret: str) -> Column:
    """The country code stays; ten digits under +1 or without a code stay a valid area, exchange and line."""
    code = F.regexp_extract(x, r"^\+(?:1|[2-9][0-9]{0,2})", 0)
    rest = F.substr(x, F.length(code) + 1, F.length(x))
    d = _digits(rest)
    n = F.length(d)
    north = code.isin("+1", "") & d.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
    area, exchange, line = (F.substr(d, F.lit(a), F.lit(b)).cast("long") for a, b in ((1, 3), (4, 3), (7, 4)))
    size = F.lit(80_000).cast("long")
    v = feistel((area - 200) * 8_000_000 + (exchange - 200) * 10_000 + line, size, size, secret, "phone+1")
    plan = F.concat(
        (F.floor(v / 8_000_000) + 200).cast("string"), (F.floor(v / 10_000) % 800 + 200).cast("string"), F.lpad((v % 10_000).cast("string"), 4, "0")
    )
    low = F.floor(n / 2).cast("int")
    other = F.lpad(feistel(d.cast("long"), _ten(n - low), _ten(low), secret, "phone").cast("string"), n, F.lit("0"))
    return F.when(F.length(_digits(x)).between(8, 15), F.concat(code, _refill(rest, F.when(north, plan).otherwise(other))))


def _ip(x: Column, secret: str) -> Column:
    parts = F.split(x, r"\.")
    octets = [F.get(parts, F.lit(i)).cast("long") for i in range(4)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    size = F.lit(65_536).cast("long")
    v = feistel(value, size, size, secret, "ip")
    fresh = F.concat_ws(".", *[(F.floor(v / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)])
    return F.when(F.greatest(*octets) <= 255, fresh)


def _moved_day(day: Column, secret: str) -> Column:
    v = feistel(F.date_diff(day, F.lit(FIRST_DAY).cast("date")).cast("long"), F.lit(DAY_A).cast("long"), F.lit(DAY_B).cast("long"), secret, "date")
    return F.date_add(F.lit(FIRST_DAY).cast("date"), v.cast("int"))


def _iso_date(x: Column, secret: str) -> Column:
    day = F.try_to_date(x, "yyyy-MM-dd")
    return F.when(day.isNotNull(), F.date_format(_moved_day(day, secret), "yyyy-MM-dd"))


def _day_date(x: Column, secret: str) -> Column:
    """Day first, or month first where day first is no date; order and separator stay."""
    sep = F.substr(x, F.lit(3), F.lit(1))
    first, second, year = (F.substr(x, F.lit(a), F.lit(b)) for a, b in ((1, 2), (4, 2), (7, 4)))
    day_first = F.try_to_date(F.concat_ws("-", year, second, first), "yyyy-MM-dd")
    moved = _moved_day(F.coalesce(day_first, F.try_to_date(F.concat_ws("-", year, first, second), "yyyy-MM-dd")), secret)
    day, month = F.date_format(moved, "dd"), F.date_format(moved, "MM")
    ordered = F.when(day_first.isNotNull(), F.concat(day, sep, month)).otherwise(F.concat(month, sep, day))
    return F.when(moved.isNotNull(), F.concat(ordered, sep, F.date_format(moved, "yyyy")))


def _ssn(x: Column, secret: str) -> Column:
    area, group, serial = (F.substr(x, F.lit(a), F.lit(b)).cast("long") for a, b in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = area - F.when(area > 666, 2).otherwise(1)
    v = feistel((index * 99 + group - 1) * 9999 + serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), secret, "ssn")
    i = F.floor(v / (9999 * 99))
    fresh = F.concat_ws(
        "-",
        F.lpad((i + F.when(i >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
        F.lpad((F.floor(v / 9999) % 99 + 1).cast("string"), 2, "0"),
        F.lpad((v % 9999 + 1).cast("string"), 4, "0"),
    )
    return F.when(valid, fresh)


def _iban(x: Column, secret: str) -> Column:
    flat = F.replace(x, F.lit(" "), F.lit(""))
    country, account = F.substr(flat, F.lit(1), F.lit(2)), F.substr(flat, F.lit(5), F.length(flat))
    valid = _mod97(F.concat(account, F.substr(flat, F.lit(1), F.lit(4)))) == 1
    fresh = feistel_text(account, secret, "iban")
    check = F.lpad((98 - _mod97(F.concat(fresh, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, _refill(x, F.concat(country, check, fresh), "[A-Z0-9]"))


def _email(x: Column, secret: str) -> Column:
    name = F.substring_index(x, "@", 1)
    return F.concat(feistel_text(name, secret, "email"), F.substr(x, F.length(name) + 1, F.length(x)))


REPLACE: dict[str, Callable[[Column, str], Column]] = {
    "email": _email, "iban": _iban, "ip": _ip, "iso_date": _iso_date, "day_date": _day_date, "phone": _phone, "ssn": _ssn, "card": _card,
}


def pseudonymise(docs: DataFrame, secret: str) -> DataFrame:
    """``text`` with every validated value replaced, and ``found``: the kinds replaced, in order."""
    text = F.col("text")
    hits = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))

    def replaced(x: Column) -> Column:
        kind = F.lit(None).cast("string")
        fresh = F.lit(None).cast("string")
        for k in reversed(KINDS):
            whole = x.rlike(f"^(?:{PATTERNS[k]})$")
            fresh = F.when(whole, REPLACE[k](x, secret)).otherwise(fresh)
            kind = F.when(whole, F.lit(k)).otherwise(kind)
        return F.struct(F.coalesce(fresh, x).alias("text"), F.when(fresh.isNotNull(), kind).alias("kind"))

    marked = docs.withColumn("_new", F.when(text.rlike(ANY), F.transform(hits, replaced)))
    pieces = F.zip_with(F.split(text, ANY, -1), F.col("_new.text"), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
    return (
        marked.withColumn("text", F.when(F.col("_new").isNotNull(), F.array_join(pieces, "")).otherwise(text))
        .withColumn("found", F.coalesce(F.array_compact(F.col("_new.kind")), F.array().cast("array<string>")))
        .drop("_new")
    )
