"""Pseudonyms of personal data that keep its format, by a keyed Feistel permutation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dayweave.llm.text import let

KEY = "pseudonyms"
ROUNDS = 8

# What counts as a candidate of each kind.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
SECRET = r"""(?<=(?i:token|secret|api_key|password) {0,2}[=:] {0,2}["']?)(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"""
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])"
PHONE = r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DAY_FIRST = r"(?<![0-9./])[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}(?![0-9])"
YEAR_FIRST = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
CARD = (
    r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
)
ANY = "|".join((EMAIL, SECRET, IBAN, PHONE, SOCIAL, DAY_FIRST, YEAR_FIRST, ADDRESS, CARD))

# Dates are permuted within one whole period of the calendar, whose days factor well.
FIRST_DAY, LAST_DAY = "1800-01-01", "2199-12-31"
DAY_FACTORS = (189, 773)


def _digest(key: str, kind: str, round_: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), value), 512)


def feistel_number(value: Column, low: int, high: int, key: str, kind: str) -> Column:
    """A keyed permutation of the numbers below low * high."""

    def step(state, i):
        def drawn(x, modulus):
            digits = F.substring(_digest(key, kind, i, x.cast("string")), 1, 15)
            return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(modulus))

        left = F.when(i % 2 == 0, F.pmod(state["a"] + drawn(state["b"], low), F.lit(low))).otherwise(state["a"])
        right = F.when(i % 2 == 1, F.pmod(state["b"] + drawn(state["a"], high), F.lit(high))).otherwise(state["b"])
        return F.struct(left.alias("a"), right.alias("b"))

    value = value.cast("long")
    start = F.struct(F.floor(value / high).cast("long").alias("a"), F.pmod(value, F.lit(high)).alias("b"))
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda s: s["a"] * high + s["b"])


def _shifted(text: Column, digest: Column, hexadecimal: bool) -> Column:
    """Each digit moved within the digits and each letter within its case; the rest stays."""
    letters = 6 if hexadecimal else 26

    def move(c, i):
        by = F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        within = lambda first, n: F.char(first + F.pmod(F.ascii(c) - first + by, F.lit(n)))
        return (
            F.when(c.between("0", "9"), within(48, 10))
            .when(c.between("a", "z"), within(97, letters))
            .when(c.between("A", "Z"), within(65, letters))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), move), "")


def feistel_text(text: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """A keyed permutation of the texts with the same kinds of characters in the same places."""
    half = F.floor(F.length(text) / 2).cast("int")

    def step(state, i):
        left = _shifted(state["a"], _digest(key, kind, i, state["b"]), hexadecimal)
        right = _shifted(state["b"], _digest(key, kind, i, state["a"]), hexadecimal)
        return F.struct(
            F.when(i % 2 == 0, left).otherwise(state["a"]).alias("a"),
            F.when(i % 2 == 1, right).otherwise(state["b"]).alias("b"),
        )

    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda s: F.concat(s["a"], s["b"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(mask: Column, digits: Column) -> Column:
    """`mask` with its digits replaced, in order, by `digits`."""

    def step(state, c):
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(state["out"], F.when(is_digit, F.substring(digits, state["at"], F.lit(1))).otherwise(c)).alias("out"),
            (state["at"] + is_digit.cast("int")).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(F.filter(F.split(mask, ""), lambda c: c != ""), start, step, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """The Luhn sum; a multiple of 10 for a valid number."""

    def step(total, i):
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, digit).otherwise(2 * digit - F.when(digit > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)


def _card(m: Column, key: str) -> Column:
    def valid(digits):
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)

        def checked(new):
            return _refilled(m, F.concat(new, F.pmod(10 - _luhn(F.concat(new, F.lit("0"))) % 10, F.lit(10)).cast("string")))

        return F.when(_luhn(digits) % 10 == 0, let(feistel_text(body, key, "card"), checked))

    return let(_digits(m), valid)


def _iban_check(country: Column, account: Column) -> Column:
    """The two check digits, by the remainder of the written-out number."""

    def step(rest, c):
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(rest * F.when(value > 9, 100).otherwise(10) + value, F.lit(97))

    chars = F.filter(F.split(F.concat(account, country, F.lit("00")), ""), lambda c: c != "")
    return F.lpad((98 - F.aggregate(chars, F.lit(0), step)).cast("string"), 2, "0")


def _iban(m: Column, key: str) -> Column:
    country, account = F.substring(m, 1, 2), F.substring(m, F.lit(5), F.length(m))
    valid = F.substring(m, 3, 2) == _iban_check(country, account)
    return F.when(valid, let(feistel_text(account, key, "iban"), lambda new: F.concat(country, _iban_check(country, new), new)))


def _phone(m: Column, key: str) -> Column:
    def replaced(digits):
        area = F.length(digits) - 9
        own = F.substring(digits, area, F.lit(10))
        return _refilled(m, F.concat(F.substring(digits, F.lit(1), area - 1), feistel_text(own, key, "phone")))

    return let(_digits(m), replaced)


def _social(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    rank = area - 1 - (area > 666).cast("int")
    low, high = 898, 99 * 9999

    def written(x):
        a = F.floor(x / high) + 1
        a = a + (a >= 666).cast("int")
        g, s = F.floor(x % high / 9999) + 1, x % 9999 + 1
        return F.concat_ws("-", *(F.lpad(v.cast("string"), n, "0") for v, n in ((a, 3), (g, 2), (s, 4))))

    number = rank.cast("long") * high + (group - 1) * 9999 + serial - 1
    return F.when(valid, let(feistel_number(number, low, high, key, "social"), written))


def _address(m: Column, key: str) -> Column:
    def replaced(parts):
        octets = [F.element_at(parts, i).cast("int") for i in (1, 2, 3, 4)]
        valid = reduce(lambda a, b: a & b, [o <= 255 for o in octets])
        number = reduce(lambda a, b: a * 256 + b, [o.cast("long") for o in octets])

        def written(x):
            return F.concat_ws(".", *(F.pmod(F.shiftright(x, n), F.lit(256)).cast("string") for n in (24, 16, 8, 0)))

        return F.when(valid, let(feistel_number(number, 65536, 65536, key, "address"), written))

    return let(F.split(m, r"\."), replaced)


def _date(m: Column, key: str) -> Column:
    """A valid date becomes another of the same period, written as it was; a date with the day
    and the month in front is read day first, and month first where only that is valid."""
    slash = F.substring(m, 3, 1)

    def read(a, b, c):
        return F.concat_ws("-", a, b, c).try_cast("date")

    parts = [F.substring(m, at, n) for at, n in ((1, 2), (4, 2), (7, 4))]
    iso = m.rlike(r"^[0-9]{4}-")
    day_first = read(parts[2], parts[1], parts[0])
    month_first = read(parts[2], parts[0], parts[1])
    day = F.when(iso, m.try_cast("date")).otherwise(F.coalesce(day_first, month_first))
    order = F.when(iso, 0).when(day_first.isNotNull(), 1).otherwise(2)

    def moved(d):
        offset = F.datediff(d, F.lit(FIRST_DAY).cast("date"))
        inside = d.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))

        def written(x):
            new = F.date_add(F.lit(FIRST_DAY).cast("date"), x.cast("int"))
            year, month, date = (F.date_format(new, f) for f in ("yyyy", "MM", "dd"))
            return (
                F.when(order == 0, F.concat_ws("-", year, month, date))
                .when(order == 1, F.concat(date, slash, month, slash, year))
                .otherwise(F.concat(month, slash, date, slash, year))
            )

        return F.when(inside, let(feistel_number(offset, *DAY_FACTORS, key, "date"), written))

    return let(day, moved)


def _email(m: Column, key: str) -> Column:
    """The name is permuted; the domain stays. Upper and lower case are not the same name."""
    at = F.instr(m, "@")
    return F.concat(feistel_text(F.substring(m, F.lit(1), at - 1), key, "email"), F.substring(m, at, F.length(m)))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate, or the candidate itself if it is not valid."""
    whole = lambda pattern: m.rlike(f"^(?:{pattern})$")
    new = (
        F.when(F.instr(m, "@") > 0, _email(m, key))
        .when(whole(IBAN), _iban(m, key))
        .when(m.rlike("^[0-9A-Fa-f]{32,64}$"), feistel_text(m, key, "secret", hexadecimal=True))
        .when(whole(ADDRESS), _address(m, key))
        .when(whole(SOCIAL), _social(m, key))
        .when(whole(DAY_FIRST) | whole(YEAR_FIRST), _date(m, key))
        .when(whole(CARD), _card(m, key))
        .when(whole(PHONE), _phone(m, key))
    )
    return F.coalesce(new, m)


def pseudonymise(df: DataFrame, column: str = "text", key: str = KEY, count: str | None = "n_replaced") -> DataFrame:
    """Replace personal data in `column` by pseudonyms of the same format.

    Card numbers and account numbers with right check digits, phone numbers, social security
    numbers, dates, network addresses, mail names and secrets are permuted within their own
    format by a Feistel network under `key`, so equal values stay equal in every document and
    a valid value stays valid. Candidates that fail their check stay as they are. A missing
    text stays missing; an empty one, and one without candidates, is unchanged; one of any length is
    rewritten whole. Every row is
    treated alone: ties and repeated rows give equal results, other columns are kept. The number
    of values replaced goes to the column `count`, in place of one of that name; with None it is
    left out.
    """
    text = F.col(column)

    def rewritten(found):
        # Between and around the candidates lies what splitting at them gives.
        rest = F.split(text, ANY, -1)
        new = F.transform(found, lambda m: pseudonym(m, key))
        pairs = F.zip_with(rest, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        changed = F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda c: c)
        return F.struct(F.array_join(pairs, "").alias("text"), F.size(changed).cast("long").alias("n"))

    found = F.regexp_extract_all(column, F.lit(ANY), F.lit(0))
    # Every candidate has a digit or an @, which is quickly seen.
    has = text.rlike("[0-9@]")
    none = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    result = F.when(has, let(found, lambda f: F.when(F.size(f) > 0, rewritten(f)).otherwise(none))).otherwise(none)
    new = {column: F.col("__new.text")} | ({count: F.col("__new.n")} if count else {})
    return df.withColumn("__new", result).withColumns(new).drop("__new")
