"""Personal data replaced by pseudonyms of the same format: keyed Feistel permutations of validated numbers and dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: The key is a secret of its user; this one serves tests and the fixed queries.
KEY = "quire-demo-key"
#: What is looked for, in this order at each place.
EMAIL = r"(?<![\p{L}\p{N}._%+'-])[\p{L}\p{N}._%+'-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
SECRET = r"(?<![A-Za-z])(?i:token|secret|password|passwd|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/=-]{16,}"
IBAN = r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
DATE = r"(?<![\w.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w-])|(?<![\w./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![\w/])"
ADDRESS = r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"
SOCIAL = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[.-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?!\w)"
CARD = r"(?<!\w)(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?!\w)"
ALL = "|".join((EMAIL, SECRET, IBAN, DATE, ADDRESS, SOCIAL, PHONE, CARD))
# Calling codes of one and of two digits; all others have three.
CODES_OF_ONE = ("1", "7")
CODES_OF_TWO = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)
#: Dates are permuted among these days; others stay.
FIRST_DAY, DAYS = "1900-01-01", 73_049


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keyed(key: str, text: Column) -> Column:
    """48 bits that follow from the key and a text."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(key + "|"), text), 256), 1, 12), 16, 10).cast("long")


def exchanged(a: Column, b: Column, low: Column, high: Column, key: str, tweak: str, whole: Callable[[Column], Column]) -> Column:
    """whole of a struct of parts a, under high, and b, under low: alternately each gets a keyed number, from the other, added modulo its range."""

    def step(state: Column, i: Column) -> Column:
        a, b = state["a"], state["b"]
        salt = F.concat(F.lit(tweak + ":"), low.cast("string"), F.lit(":"), i.cast("string"), F.lit(":"))
        return F.when(i % 2 == 0, F.struct(((a + keyed(key, F.concat(salt, b.cast("string")))) % high).alias("a"), b.alias("b"))).otherwise(
            F.struct(a.alias("a"), ((b + keyed(key, F.concat(salt, a.cast("string")))) % low).alias("b"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.alias("a"), b.alias("b")), step, whole)


def feistel(value: Column, low: int | Column, high: int | Column, key: str, tweak: str) -> Column:
    """A permutation of 0 to high * low - 1."""
    low, high = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (low, high))
    return exchanged(F.floor(value / low).cast("long"), value % low, low, high, key, tweak, lambda s: s["a"] * low + s["b"])


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """Another string of as many digits (2 to 34), one to one among those of its length. Its halves are numbers of their own, so no digit is out of reach."""
    n = F.length(digits)
    left, right = F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")
    part = lambda start, size: F.substring(digits, start, size).try_cast("long")
    low, high = (F.pow(F.lit(10.0), size).cast("long") for size in (right, left))
    join = lambda s: F.concat(F.lpad(s["a"].cast("string"), left, "0"), F.lpad(s["b"].cast("string"), right, "0"))
    return exchanged(part(F.lit(1), left), part(left + 1, right), low, high, key, tweak, join)


def overlay(pattern: Column, digits: Column) -> Column:
    """pattern with its digits, in order, taken from digits."""
    chars = F.split(pattern, "")
    put = F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, F.length(digits_of(F.substring(pattern, F.lit(1), i + 1))), F.lit(1))).otherwise(c))
    return F.array_join(put, "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits whose last is at an even place."""
    values = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def card(text: Column, key: str) -> Column:
    """Numbers with a valid Luhn digit: the rest is permuted and the digit follows."""

    def replaced(digits: Column) -> Column:
        body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        return let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    return let(digits_of(text), lambda d: F.when(luhn_sum(d) % 10 == 0, overlay(text, replaced(d))).otherwise(text))


def iban_rest(text: Column) -> Column:
    """Remainder by 97 of an IBAN without spaces, letters read as 10 to 35."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.try_cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def iban(text: Column, key: str) -> Column:
    """Valid IBANs: the digits of the account are permuted, all of them, and the check digits follow."""

    def replaced(plain: Column) -> Column:
        account = F.substring(plain, F.lit(5), F.length(plain))
        digits = digits_of(account)
        rest = overlay(account, permuted_digits(digits, key, "iban"))
        check = 98 - iban_rest(F.concat(F.substring(plain, 1, 2), F.lit("00"), rest))
        return F.concat(F.lpad(check.cast("string"), 2, "0"), digits_of(rest))

    plain = F.replace(text, F.lit(" "), F.lit(""))
    valid = (F.length(plain) >= 15) & (iban_rest(plain) == 1) & (F.length(digits_of(F.substring(plain, F.lit(5), F.length(plain)))) >= 2)
    return F.when(valid, overlay(text, replaced(plain))).otherwise(text)


def walk(value: Column, step: Callable[[Column], Column], inside: Callable[[Column], Column], times: int) -> Column:
    """step once, and again while the result is outside: a permutation of what is inside."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), step(value), lambda v, i: F.when(inside(v), v).otherwise(step(v)))


def date(text: Column, key: str) -> Column:
    """Days that exist, from FIRST_DAY on, are permuted; written year-month-day, or day before month, else month before day."""

    def replaced(layout: str) -> tuple[Column, Column]:
        day = F.date_diff(F.try_to_date(text, layout), F.lit(FIRST_DAY).cast("date"))
        inside = lambda v: v < DAYS
        new = walk(day.cast("long"), lambda v: feistel(v, 300, 300, key, "date"), inside, 48)
        return F.coalesce((day >= 0) & (day < DAYS), F.lit(False)), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), layout)

    out = text
    for layout in ("MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy-MM-dd"):
        ok, new = replaced(layout)
        out = F.when(ok, new).otherwise(out)
    return out


def address(text: Column, key: str) -> Column:
    """IPv4 addresses, permuted among all."""
    parts = F.transform(F.split(text, r"\."), lambda p: p.cast("long"))
    whole = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + p)
    new = let(feistel(whole, 65536, 65536, key, "ip"), lambda v: F.concat_ws(".", *(F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0))))
    return F.when(F.forall(parts, lambda p: p <= 255), new).otherwise(text)


def social(text: Column, key: str) -> Column:
    """Valid social security numbers, permuted among the valid ones."""
    area, middle, serial = (lambda v: F.floor(v / 1_000_000)), (lambda v: F.floor(v / 10_000) % 100), (lambda v: v % 10_000)
    valid = lambda v: (area(v) > 0) & (area(v) != 666) & (area(v) < 900) & (middle(v) > 0) & (serial(v) > 0)
    number = digits_of(text).cast("long")
    new = walk(number, lambda v: feistel(v, 100_000, 10_000, key, "ssn"), valid, 24)
    return F.when(valid(number), overlay(text, F.lpad(new.cast("string"), 9, "0"))).otherwise(text)


def phone(text: Column, key: str) -> Column:
    """Numbers of 7 to 15 digits: all but the calling code behind + is permuted, however the digits are spaced."""

    def replaced(digits: Column) -> Column:
        listed = F.when(F.substring(digits, 1, 1).isin(*CODES_OF_ONE), 1).when(F.substring(digits, 1, 2).isin(*CODES_OF_TWO), 2).otherwise(3)
        code = F.when(F.startswith(text, F.lit("+")), listed).otherwise(0)
        new = F.concat(F.substring(digits, F.lit(1), code), permuted_digits(F.substring(digits, code + 1, F.length(digits)), key, "phone"))
        return F.when(F.length(digits).between(7, 15), overlay(text, new)).otherwise(text)

    return let(digits_of(text), replaced)


def email(text: Column, key: str) -> Column:
    """Addresses of the same person, in any case, get the same user and host, in a domain that nobody has. Users of 64 and hosts of 80 bits: among a
    thousand million addresses, two different ones get one user of one host less than once in a thousand corpora."""
    at = F.split(F.lower(text), "@")
    digest = lambda part, n: F.substring(F.sha2(F.concat(F.lit(key + "|mail|"), part), 256), 1, n)
    return F.concat(F.lit("u"), digest(F.lower(text), 16), F.lit("@h"), digest(F.get(at, F.lit(1)), 20), F.lit(".example"))


def secret(text: Column, key: str) -> Column:
    """The value behind the first sign, and a quote, becomes as many hexadecimal digits; however it is written, one value has one pseudonym."""
    value = F.regexp_extract(text, r"[=:]\s{0,3}[\"']?([A-Za-z0-9_+/=-]{16,})\z", 1)
    digest = F.concat(*(F.sha2(F.concat(F.lit(f"{key}|secret{i}|"), value), 256) for i in range(2)))
    return F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(value)), F.substring(F.repeat(digest, 64), F.lit(1), F.length(value)))


def whole(pattern: str) -> str:
    """A pattern for a match alone."""
    return f"^(?:{pattern})$"


#: Kind, its pattern on its own, and what takes its place.
KINDS: list[tuple[str, str, Callable[[Column, str], Column]]] = [
    ("email", EMAIL, email), ("secret", SECRET, secret), ("iban", IBAN, iban), ("date", DATE, date), ("address", ADDRESS, address),
    ("social", SOCIAL, social), ("phone", PHONE, phone), ("card", CARD.replace(r"\2", r"\1"), card),
]


def pseudonym(match: Column, key: str) -> Column:
    out = match
    for _, pattern, change in reversed(KINDS):
        out = F.when(match.rlike(whole(pattern)), change(match, key)).otherwise(out)
    return out


def pseudonymize(documents: DataFrame, key: str = KEY, column: str = "text", count: str | None = None) -> DataFrame:
    """documents with personal data in column replaced; count: name of a column for how many values were, if wanted.

    Equal values get equal pseudonyms in all documents under one key. Numbers that fail their check (Luhn, remainder by 97, ranges) stay, as do
    dates that do not exist. All but the values found stays byte for byte; null stays null, with count 0. Other columns are kept whatever their names.
    """
    text = F.col(f"`{column}`")
    found = F.when(text.rlike("[0-9@]|(?i:token|secret|passw|api)"), F.regexp_extract_all(text, F.lit(ALL), F.lit(0)))
    names = [f"_c{i}" for i in range(len(documents.columns))]
    at = names[documents.columns.index(column)]
    renamed = documents.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(documents.columns, names, strict=True)), found.alias("_found"))
    renamed = renamed.withColumn("_new", F.transform("_found", lambda m: pseudonym(m, key)))
    gaps = F.split(at, ALL, -1)
    joined = F.array_join(F.zip_with(gaps, "_new", lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    changed = F.coalesce(F.size(F.filter(F.zip_with("_found", "_new", lambda a, b: a != b), lambda x: x)), F.lit(0))
    out = [F.when(F.size("_found") > 0, joined).otherwise(F.col(n)).alias(c) if n == at else F.col(n).alias(c) for c, n in zip(documents.columns, names, strict=True)]
    return renamed.select(*out, *([F.when(F.col("_found").isNull(), 0).otherwise(changed).cast("int").alias(count)] if count else []))
