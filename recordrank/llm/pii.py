"""Format-preserving pseudonyms of personal values, with DataFrame functions only.

A value is an array of symbols with their moduli: a digit has 10, a letter 26, an octet of an address 256, and a symbol
that the format fixes has 1. A keyed Feistel network permutes the arrays of one format: each round adds, symbol by symbol and
modulo its own modulus, an HMAC-SHA-512 keystream of the other half. So equal values get equal pseudonyms in all documents,
different values get different ones, and a pseudonym has the format of its value. Of numbers the digits alone are permuted and put back
between the separators, so one number written in two ways has one pseudonym.

The key reaches the executors as the value of a scalar subquery over a table of one row: no plan, and so no event log, has it in its text.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the kinds. A run is entered at its start only, so no text takes more than linear time.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
DATE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[/.]\d{2}[/.]\d{4})(?!\d)"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)"
TAX = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})(?!\d)"
SECRET = r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])"
#: The two-digit country codes of the international numbering plan; those that begin with 1 or 7 have one digit, all others three.
COUNTRIES_OF_TWO = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ALL = "|".join(f"(?:{p})" for p in (EMAIL, DATE, ADDRESS, TAX, CARD, PHONE, SECRET))
#: Days of a block within which dates are permuted, counted from 1900-01-01: 270 times 270, about 200 years.
ERA = 270 * 270

_PAIR = "struct<a:array<int>,b:array<int>,ma:array<int>,mb:array<int>>"


def key_blocks(key: str) -> tuple[bytearray, bytearray]:
    """The inner and the outer block of HMAC-SHA-512."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    return bytearray(b ^ 0x36 for b in raw), bytearray(b ^ 0x5C for b in raw)


def feistel(values: Column, moduli: Column, secret: Column, kind: str | Column, rounds: int = 10) -> Column:
    """The permuted symbols; ``rounds`` is even, and ``secret`` has the blocks ``inner`` and ``outer`` of the key."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    half = F.floor(F.size(values) / 2).cast("int")
    rest = F.size(values) - half

    def turn(state: Column, number: Column) -> Column:
        a, b, ma, mb = (state[x] for x in ("a", "b", "ma", "mb"))
        message = F.concat_ws("|", kind, number.cast("string"), F.array_join(b.cast("array<string>"), ","), F.array_join(F.concat(ma, mb).cast("array<string>"), ","))
        stream = F.sha2(F.concat(secret["outer"], F.unhex(F.sha2(F.concat(secret["inner"], message.cast("binary")), 512))), 512)
        shifted = F.transform(a, lambda x, i: F.pmod(x + F.conv(F.substring(stream, F.pmod(i, F.lit(20)) * 6 + 1, F.lit(6)), 16, 10).cast("int"), F.element_at(ma, i + 1)))
        return F.struct(b.alias("a"), shifted.alias("b"), mb.alias("ma"), ma.alias("mb")).cast(_PAIR)

    start = F.struct(F.slice(values, F.lit(1), half).alias("a"), F.slice(values, half + 1, rest).alias("b"), F.slice(moduli, F.lit(1), half).alias("ma"), F.slice(moduli, half + 1, rest).alias("mb")).cast(_PAIR)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _digits(digits: Column, secret: Column, kind: str | Column) -> Column:
    """A string of digits, permuted."""
    return F.array_join(feistel(F.split(digits, "").cast("array<int>"), F.array_repeat(F.lit(10), F.length(digits)), secret, kind).cast("array<string>"), "")


def _put_back(m: Column, digits: Column) -> Column:
    """The match with its digits replaced, in order, by others."""
    nth = lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c.between("0", "9"), F.substring(digits, nth(i), F.lit(1))).otherwise(c)), "")


def _letters(m: Column, secret: Column, kind: str, letters: int = 26) -> Column:
    """The string with its digits and letters permuted."""
    chars = F.split(m, "")
    code = lambda c: F.ascii(c)

    def base(c: Column) -> Column:
        within = lambda a, b: (code(c) >= a) & (code(c) <= b)
        return F.when(within(48, 57), 48).when(within(97, 122), 97).when(within(65, 90), 65).otherwise(0)

    bases = F.transform(chars, base)
    moduli = F.transform(bases, lambda b: F.when(b == 0, 1).when(b == 48, 10).otherwise(letters))
    values = F.zip_with(chars, bases, lambda c, b: F.when(b == 0, 0).otherwise(code(c) - b))
    new = F.arrays_zip(feistel(values, moduli, secret, kind).alias("v"), bases.alias("b"), chars.alias("c"))
    return F.array_join(F.transform(new, lambda x: F.when(x["b"] == 0, x["c"]).otherwise(F.chr(x["v"] + x["b"]))), "")


def _luhn(digits: Column) -> Column:
    """The sum of the Luhn rule over a string of digits, the last of which has weight 1."""
    parts = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") / 5).cast("int") + F.pmod(c.cast("int") * 2, F.lit(10))))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def pseudonym(m: Column, secret: Column) -> Column:
    """The pseudonym of one match, or the match where validation fails."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    # a card: all but the last digit are permuted, and that one keeps the checksum right
    body = _digits(F.substring(digits, F.lit(1), F.length(digits) - 1), secret, "card")
    check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    card = _put_back(m, F.concat(body, check.cast("string")))
    # a number: the country's code stays, and numbers of different countries are permuted apart
    long = F.when(digits.rlike("^[17]"), 1).when(F.substring(digits, 1, 2).isin(COUNTRIES_OF_TWO), 2).otherwise(3)
    country = F.substring(digits, F.lit(1), F.when(m.startswith("+"), long).otherwise(0))
    number = _put_back(m, F.concat(country, _digits(F.substring(digits, F.length(country) + 1, F.length(digits)), secret, F.concat(F.lit("number+"), country))))
    octets = F.split(m, "[.]").cast("array<int>")
    address = F.array_join(feistel(octets, F.array_repeat(F.lit(256), 4), secret, "address").cast("array<string>"), ".")
    iso = F.substring(m, 5, 1).isin("-", "/")
    sep = F.when(iso, F.substring(m, 5, 1)).otherwise(F.substring(m, 3, 1))
    parts = F.split(m, "[-/.]")
    day = F.when(iso, F.try_to_date(F.array_join(parts, "-"), "yyyy-MM-dd")).otherwise(F.try_to_date(F.array_join(F.reverse(parts), "-"), "yyyy-MM-dd"))
    since = F.date_diff(day, F.lit("1900-01-01").cast("date"))
    era = F.floor(since / F.lit(ERA)).cast("int")
    spot = F.pmod(since, F.lit(ERA))
    moved = feistel(F.array(F.floor(spot / 270).cast("int"), F.pmod(spot, F.lit(270)).cast("int")), F.array(F.lit(270), F.lit(270)), secret, "date")
    new_day = F.date_add(F.lit("1900-01-01").cast("date"), (era * ERA + moved[0] * 270 + moved[1]).cast("int"))
    y, mo, d = (F.date_format(new_day, x) for x in ("yyyy", "MM", "dd"))
    date = F.when(iso, F.concat(y, sep, mo, sep, d)).otherwise(F.concat(d, sep, mo, sep, y))
    at = F.instr(m, "@")
    email = F.concat(_letters(F.substring(m, F.lit(1), at - 1), secret, "email"), F.substring(m, at, F.length(m)))
    whole_era = (era >= -26) & (era <= 39)  # years 1 to 9999
    return (
        F.when(at > 0, email)
        .when(m.rlike(f"^(?:{DATE})$"), F.when(day.isNotNull() & whole_era, date).otherwise(m))
        .when(m.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.when(F.forall(octets, lambda x: x <= 255), address).otherwise(m))
        .when(m.rlike(f"^(?:{CARD})$"), F.when(F.pmod(_luhn(digits), F.lit(10)) == 0, card).otherwise(m))
        .when(m.rlike(f"^(?:{SECRET})$"), _letters(m, secret, "secret", 6))
        .otherwise(number)
    )


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, n_found, n_changed)`` for each row of ``docs``.

    E-mail addresses (their local part), network addresses, valid dates, telephone, tax and card numbers and hexadecimal
    secrets, of either case, are replaced; a date with slashes or dots is read as day, month, year only; card numbers need a right checksum, dates need to exist, octets to be at most 255, else the text
    stays. A null text stays null with counts 0. Repeated rows are treated each; an empty table gives no rows; other columns are ignored. The
    key decides the permutation and is a secret of the caller. Dates of the last blocks before the year 9999 stay.
    """
    text = F.col(text_col)
    found = F.when(text.rlike(ALL), F.regexp_extract_all(text, F.lit(ALL), F.lit(0)))
    inner, outer = key_blocks(key)
    blocks = docs.sparkSession.createDataFrame([(inner, outer)], "inner binary, outer binary").select(F.struct("inner", "outer")).scalar()
    # behind a generator, so that the subquery is not copied into the functions over each match
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), found.alias("found"), F.explode(F.array(blocks)).alias("secret"))
    names = F.transform("found", lambda m: pseudonym(m, F.col("secret")))
    rows = rows.withColumn("names", F.when(F.col("found").isNotNull(), names))
    between = F.split("text", ALL)
    joined = F.array_join(F.zip_with(between, F.concat("names", F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.arrays_zip("found", "names"), lambda x: x["found"] != x["names"]))
    none = F.col("found").isNull()
    return rows.select("doc_id", F.when(none, F.col("text")).otherwise(joined).alias("text"), F.when(none, 0).otherwise(F.size("found")).alias("n_found"), F.when(none, 0).otherwise(changed).alias("n_changed"))
