"""Format-preserving pseudonyms for personal data, in SQL functions.

Card numbers (Luhn), IPv4 addresses, telephone numbers, US social security numbers, calendar dates and e-mail names are found by one pattern, validated, and
replaced by a keyed permutation within their format: a Feistel network over the value's characters. The characters are cut into two halves; in each of ``ROUNDS`` rounds every
character of one half moves on within its own alphabet (digits, small letters, capital letters) by a number that SHA-512 draws from key, kind, round and the other half. Each round can be undone,
so different values of a format get different pseudonyms, and equal values the same one in every document.

* card: the digits before the check digit are permuted and the check digit is made valid again; separators stay in place
* ip: the 32-bit address is permuted as eight hexadecimal digits
* phone: the ten digits after a country code; its punctuation stays
* ssn: the nine digits, permuted again until they are valid
* date: the day's number within its block of 65,536 days (1920-01-01 to 2099-06-06 is one), or of 4,096 in the last block; where the calendar of years 1 to 9999 ends within a
  block, the number is permuted again until it is a day of that calendar; year-month-day, month/day/year (day/month/year where only that is a date), day.month.year,
  with leading zeros only where the date has them
* email: the letters and digits of the local part; the domain stays

Defined cases: a null text stays null; what doesn't validate stays; the whole text is replaced match by match, left to right, so no pseudonym is replaced again; repeated rows give
repeated results; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let

ROUNDS = 8
#: Where a session names its secret key, and the public key of tests and demonstrations, which protects nothing.
KEY_SETTING, KEY = "spark.kgloom.pii.key", "not a secret: set your own"
DIGITS, SMALL, LARGE, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"

#: Fixed patterns, in the order in which they are tried at a place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z]|\.[0-9])"
KINDS = {"email": EMAIL, "ip": IP, "ssn": SSN, "date": DATE, "phone": PHONE, "card": CARD}
ANY = "|".join(KINDS.values())
#: Blocks of days that dates stay within begin here; the first and last day of years of four digits, counted from it.
FIRST_DAY, BLOCK = "1920-01-01", 65536
LOWEST, HIGHEST = ((date - datetime.date.fromisoformat(FIRST_DAY)).days for date in (datetime.date(1, 1, 1), datetime.date(9999, 12, 31)))
#: Numbers of a block that are no days: as many steps at most lead back into the calendar.
OUTSIDE = max(LOWEST % BLOCK, 4096 - 1 - HIGHEST % BLOCK)


def _shifted(half: Column, draw: Column, alphabets: tuple[str, ...]) -> Column:
    """Each character of ``half`` moved on within its alphabet by four hexadecimal digits of ``draw``; others stay. At most 32 characters."""

    def move(char: Column, k: Column) -> Column:
        by = F.conv(F.substring(draw, k * 4 + 1, F.lit(4)), 16, 10).cast("int")
        out = None
        for alphabet in alphabets:
            at = F.instr(F.lit(alphabet), char)
            moved = F.substring(F.lit(alphabet), (at - 1 + by) % len(alphabet) + 1, F.lit(1))
            out = F.when(at > 0, moved) if out is None else out.when(at > 0, moved)
        return out.otherwise(char)

    return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), move), "")


def feistel(value: Column, kind: str, key: str = KEY, alphabets: tuple[str, ...] = (DIGITS,)) -> Column:
    """The pseudonym of a string of at most 64 characters, of the same length and with the same alphabet at each place."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))

    def round_(state: Column, k: Column) -> Column:
        even = k % 2 == 0
        draw = F.sha2(F.concat_ws("/", F.lit(key), F.lit(kind), k.cast("string"), F.when(even, state["r"]).otherwise(state["l"])), 512)
        moved = _shifted(F.when(even, state["l"]).otherwise(state["r"]), draw, alphabets)
        return F.struct(F.when(even, moved).otherwise(state["l"]).alias("l"), F.when(even, state["r"]).otherwise(moved).alias("r"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_)
    return F.concat(done["l"], done["r"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _put_back(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``."""
    zero = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(state: Column, char: Column) -> Column:
        is_digit = char.rlike("[0-9]")
        return F.struct((state["n"] + is_digit.cast("int")).alias("n"), F.concat(state["out"], F.when(is_digit, F.substring(digits, state["n"] + 1, F.lit(1))).otherwise(char)).alias("out"))

    return F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), zero, step)["out"]


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a number whose last digit is the check digit."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def value(c: Column, k: Column) -> Column:
        d = c.cast("int") * (1 + k % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(each, value), F.lit(0), lambda a, d: a + d.cast("int"))


def _card(value: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(value)
    body = feistel(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key)
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return luhn_sum(digits) % 10 == 0, _put_back(value, F.concat(body, check.cast("string")))


def _ip(value: Column, key: str) -> tuple[Column, Column]:
    octets = F.transform(F.split(value, "\\."), lambda o: o.cast("int"))
    as_hex = F.array_join(F.transform(octets, lambda o: F.lpad(F.lower(F.hex(o)), 2, "0")), "")
    moved = feistel(as_hex, "ip", key, (HEX,))
    back = F.concat_ws(".", *(F.conv(F.substring(moved, 2 * k + 1, 2), 16, 10) for k in range(4)))
    return F.forall(octets, lambda o: o <= 255), back


def _phone(value: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(value)
    code = F.length(digits) - 10
    return F.length(digits) >= 10, _put_back(value, F.concat(F.substring(digits, F.lit(1), code), feistel(F.substring(digits, code + 1, F.lit(10)), "phone", key)))


def _ssn(value: Column, key: str) -> tuple[Column, Column]:
    valid = lambda d: ~d.rlike("^(000|666|9)|^...00|0000$")
    digits = _digits(value)
    # nine numbers in ten are valid: after 16 turns what is not is a matter of 1e-16
    moved = F.aggregate(F.sequence(F.lit(1), F.lit(16)), feistel(digits, "ssn", key), lambda x, _: F.when(valid(x), x).otherwise(feistel(x, "ssn", key)))
    return valid(digits), _put_back(value, moved)


def _date(value: Column, key: str) -> tuple[Column, Column]:
    iso, slash = value.rlike("^[0-9]{4}-"), value.contains("/")
    parts = F.split(value, "[-/.]")
    two_digits = lambda k: F.lpad(F.get(parts, F.lit(k)), 2, "0")
    year = F.get(parts, F.lit(2))
    written = lambda month, day: F.try_to_date(F.concat_ws("-", year, two_digits(month), two_digits(day)), "yyyy-MM-dd")
    month_first, day_first = written(0, 1), written(1, 0)
    # with slashes the month comes first, unless only the other order is a date
    turned = slash & month_first.isNull()
    day = F.when(iso, F.try_to_date(value, "yyyy-MM-dd")).when(slash & ~turned, month_first).otherwise(day_first)
    since = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    block = F.floor(since / BLOCK).cast("int")
    number = lambda x: block * BLOCK + F.conv(x, 16, 10).cast("int")
    inside = lambda x: number(x).between(LOWEST, HIGHEST)
    again = lambda x: feistel(x, "date", key, (HEX,))
    walked = lambda x: F.aggregate(F.sequence(F.lit(1), F.when(inside(x), 1).otherwise(OUTSIDE)), x, lambda y, _: F.when(inside(y), y).otherwise(again(y)))
    start = F.lpad(F.lower(F.hex(since - block * BLOCK)), F.when(block == HIGHEST // BLOCK, 3).otherwise(4), "0")
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), number(let(again(start), walked)))
    # numbers without leading zeros stay without
    padded = value.rlike("^(0|[0-9]{2}[./](0|[0-9]{2}[./]))")
    two = lambda n: F.when(padded, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    month, of_month, full = two(F.month(new)), two(F.dayofmonth(new)), F.date_format(new, "yyyy")
    out = F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(turned, F.concat_ws("/", of_month, month, full)).when(slash, F.concat_ws("/", month, of_month, full)).otherwise(F.concat_ws(".", of_month, month, full))
    return since.between(LOWEST, HIGHEST), out


def _email(value: Column, key: str) -> tuple[Column, Column]:
    local = F.substring_index(value, "@", 1)
    return F.lit(True), F.concat(feistel(local, "email", key, (DIGITS, SMALL, LARGE)), F.lit("@"), F.substring_index(value, "@", -1))


def pseudonyms(matches: Column, key: str = KEY) -> Column:
    """kind and new value of each match; kind is null where it doesn't validate and stays as it is."""

    def one(m: Column) -> Column:
        kind = F.lit(None).cast("string")
        new = m
        # the last rule written is the first tried
        rules = {"email": m.contains("@"), "ip": m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), "ssn": m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "date": m.rlike("^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\\2[0-9]{4})$"), "phone": m.rlike(r"[(+]|^[0-9]{3}[.-]|^[0-9]{1,3}[ .-]?[0-9]{3}[.-][0-9]{3}[ .-][0-9]{4}$"), "card": F.lit(True)}
        make = {"email": _email, "ip": _ip, "ssn": _ssn, "date": _date, "phone": _phone, "card": _card}
        for name in reversed(KINDS):
            valid, value = make[name](m, key)
            kind = F.when(rules[name], F.when(valid, F.lit(name))).otherwise(kind)
            new = F.when(rules[name], F.when(valid, value).otherwise(m)).otherwise(new)
        return F.struct(kind.alias("kind"), new.alias("new"))

    return F.transform(matches, one)


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The key is the session's (``KEY_SETTING``) where none is given. doc_id, the text with pseudonyms, and how many values of each kind were replaced. One projection: no shuffle."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    text = F.col("_text")
    none = F.array().cast("array<struct<kind:string,new:string>>")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).withColumn("_some", text.rlike("[@0-9]") & text.rlike(ANY))
    new = found.withColumn("_new", F.when(F.col("_some"), pseudonyms(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), key)).otherwise(none))
    pieces = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(pieces, F.concat(F.transform("_new", lambda n: n["new"]), F.array(F.lit(""))), lambda p, n: F.concat(p, n)), "")
    count = lambda kind: F.size(F.filter("_new", lambda n: n["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return new.select("doc_id", F.when(F.size("_new") > 0, joined).otherwise(text).alias("text"), *map(count, KINDS))
