"""Format-preserving pseudonyms of personal numbers and dates, in SQL functions only.

One pattern finds candidates, each is validated (checksums, ranges, calendar), and a valid one
is permuted by a keyed Feistel network over the values its format allows: payment cards keep
the Luhn digit right, IBANs their check digits, phones and social security numbers their
ranges, addresses their octets, dates the calendar of 1900 to 2099, e-mail names their
character classes. Numbers under +1 whose area or exchange starts with 0 or 1 are permuted among
themselves, apart from those of the North American plan. A network on two halves adds a keyed hash of one half to the other,
position by position modulo the position's size, so it is a permutation of any mixed radix:
equal values stay equal, different ones different, in all documents under one key.
Separators, case and all other text stay.

The text is cut at the matches and put together again, so texts may have any length and any
number of matches. Texts without digit and @ are passed through.

Defined cases: null stays null; an empty text stays empty; what fails its validation stays;
dates outside of 1900 to 2099 stay; rows are independent, repeated rows get equal results;
an empty table gives no rows; other columns pass through ``pseudonymised``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ["email", "ip", "phone", "ssn", "date", "iban", "card"]

EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})++"
IP = r"(?:\d{1,3}\.){3}\d{1,3}"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}"
SSN = r"\d{3}-\d{2}-\d{4}"
DATE = r"\d{4}[-/]\d{2}[-/]\d{2}|\d{2}\.\d{2}\.\d{4}"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
CARD = r"\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}"
CANDIDATE = rf"(?<![\w.@+%-])(?:{EMAIL}|{IP}|{PHONE}|{SSN}|{DATE}|{IBAN}|{CARD})(?![\w@-]|\.\d)"

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _digits(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda c: c.cast("int"))


def _luhn(digits: Column) -> Column:
    """Weighted sum of the digits, the last one counting once."""
    n = F.size(digits)
    weighted = F.transform(
        digits,
        lambda d, i: F.when((n - 1 - i) % 2 == 0, d).otherwise(F.when(d < 5, d * 2).otherwise(d * 2 - 9)),
    )
    return F.aggregate(weighted, F.lit(0), lambda a, d: a + d)


def _mod97(text: Column) -> Column:
    """Letters count as 10 to 35."""

    def step(a: Column, c: Column) -> Column:
        letter = F.instr(F.lit(_LETTERS), c)
        return F.when(letter > 0, (a * 100 + letter + 9) % 97).otherwise((a * 10 + c.cast("int")) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iso(text: Column) -> Column:
    """The date of either form; null where the calendar has none."""
    point = text.substr(3, 1) == "."
    year = F.when(point, text.substr(7, 4)).otherwise(text.substr(1, 4)).cast("int")
    month = F.when(point, text.substr(4, 2)).otherwise(text.substr(6, 2)).cast("int")
    day = F.when(point, text.substr(1, 2)).otherwise(text.substr(9, 2)).cast("int")
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 29).otherwise(28)).otherwise(31)
    good = year.between(1900, 2099) & month.between(1, 12) & (day >= 1) & (day <= last)
    return F.when(good, F.make_date(year, month, day))


def _full(pattern: str) -> str:
    return f"^(?:{pattern})$"


def kind_of(m: Column) -> Column:
    """The kind of a candidate, null where it is not valid."""
    d = F.regexp_replace(m, "[^0-9]", "")
    plain = F.regexp_replace(m, " ", "")
    octets = F.split(m, r"\.")
    phone = F.when(d.startswith("1"), F.length(d) == 11).otherwise(F.length(d).between(8, 15))
    ssn = d.rlike(r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}$")
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(_full(IP)), F.when(F.forall(octets, lambda x: x.cast("int") <= 255), "ip"))
        .when(m.startswith("+"), F.when(phone, "phone"))
        .when(m.rlike(_full(SSN)), F.when(ssn, "ssn"))
        .when(m.rlike(_full(DATE)), F.when(_iso(m).isNotNull(), "date"))
        .when(
            m.rlike("^[A-Z]"),
            F.when((F.length(plain) >= 15) & (_mod97(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))) == 1), "iban"),
        )
        .otherwise(F.when((_luhn(_digits(m)) % 10 == 0) & d.rlike("[1-9]"), "card"))
    )


def _classes(chars: Column) -> Column:
    """(value, size) of characters: letters and digits within their class, others fixed."""

    def one(c: Column) -> Column:
        a = F.ascii(c)
        value, size = F.lit(0), F.lit(1)
        for low, n in ((48, 10), (65, 26), (97, 26)):
            inside = a.between(low, low + n - 1)
            value, size = F.when(inside, a - low).otherwise(value), F.when(inside, n).otherwise(size)
        return F.struct(value.cast("int").alias("v"), size.cast("int").alias("b"))

    return F.transform(chars, one)


def _numbers(values: list[Column], sizes: list[int]) -> Column:
    return F.array(*[F.struct(v.cast("int").alias("v"), F.lit(b).alias("b")) for v, b in zip(values, sizes)])


def _nanp(digits: Column) -> Column:
    return (F.get(digits, F.lit(1)) >= 2) & (F.get(digits, F.lit(4)) >= 2)


def places_of(m: Column, kind: Column) -> Column:
    """A valid candidate as a mixed-radix number: array of (value, size)."""
    d = _digits(m)
    octets = F.split(m, r"\.")
    ten = lambda x: F.struct(x.alias("v"), F.lit(10).alias("b"))
    area = F.substring(m, 1, 3).cast("int")
    day = F.datediff(_iso(m), F.lit("1900-01-01").cast("date"))
    plain = F.regexp_replace(m, " ", "")
    # North American numbers start their area and their exchange with 2 to 9.
    nanp = F.transform(
        F.slice(d, 2, 10),
        lambda x, i: F.struct(F.when(i.isin(0, 3), x - 2).otherwise(x).alias("v"), F.when(i.isin(0, 3), 8).otherwise(10).alias("b")),
    )
    # The first digits of area and exchange of all others: 20 pairs from 0 or 1, 16 pairs to 0 or 1.
    one, four = F.get(d, F.lit(1)), F.get(d, F.lit(4))
    first = F.when(one < 2, one * 10 + four).otherwise(20 + (one - 2) * 2 + four)
    odd = F.concat(F.array(F.struct(first.alias("v"), F.lit(36).alias("b"))), F.transform(F.concat(F.slice(d, 3, 2), F.slice(d, 6, 6)), ten))
    other = F.transform(F.slice(d, 2, F.size(d) - 1), ten)
    return (
        F.when(kind == "email", _classes(F.split(F.substring_index(m, "@", 1), "")))
        .when(kind == "ip", F.transform(octets, lambda x: F.struct(x.cast("int").alias("v"), F.lit(256).alias("b"))))
        .when(kind == "phone", F.when(d[0] == 1, F.when(_nanp(d), nanp).otherwise(odd)).otherwise(other))
        .when(
            kind == "ssn",
            _numbers([area - F.when(area > 666, 2).otherwise(1), F.substring(m, 5, 2).cast("int") - 1, F.substring(m, 8, 4).cast("int") - 1], [898, 99, 9999]),
        )
        # 200 years are 73 049 = 17 x 4 297 days.
        .when(kind == "date", _numbers([F.floor(day / 4297), day % 4297], [17, 4297]))
        .when(kind == "iban", _classes(F.split(F.substring(plain, 5, 100), "")))
        .otherwise(F.transform(F.slice(d, 1, F.size(d) - 1), ten))
    )


def feistel(places: Column, tweak: Column, key: str) -> Column:
    """The permuted values of an array of (value, size)."""
    n = F.size(places)
    half = F.floor(n / 2).cast("int")
    left, right = F.slice(places, 1, half), F.slice(places, half + 1, n - half)

    def shifted(target: Column, other: Column, number: Column) -> Column:
        seed = F.sha2(F.concat_ws("|", F.lit(key), tweak, number.cast("string"), F.array_join(F.transform(other, lambda x: x["v"].cast("string")), ",")), 256)
        return let(
            seed,
            lambda s: F.transform(
                target,
                lambda x, i: F.struct(
                    ((x["v"] + F.conv(F.substring(F.sha2(F.concat_ws("|", s, i.cast("string")), 256), 1, 8), 16, 10).cast("bigint")) % x["b"])
                    .cast("int")
                    .alias("v"),
                    x["b"].alias("b"),
                ),
            ),
        )

    def step(state: Column, number: Column) -> Column:
        even = number % 2 == 0
        return F.struct(
            F.when(even, shifted(state["l"], state["r"], number)).otherwise(state["l"]).alias("l"),
            F.when(even, state["r"]).otherwise(shifted(state["r"], state["l"], number)).alias("r"),
        )

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.alias("l"), right.alias("r")), step)
    return let(end, lambda e: F.transform(F.concat(e["l"], e["r"]), lambda x: x["v"]))


def _refill(m: Column, digits: Column) -> Column:
    """The text with its digits replaced in order."""
    chars = F.split(m, "")
    state = F.struct(F.lit("").alias("t"), F.lit(0).alias("k"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(s["t"], F.when(is_digit, digits[s["k"]].cast("string")).otherwise(c)).alias("t"),
            (s["k"] + F.when(is_digit, 1).otherwise(0)).alias("k"),
        )

    return F.aggregate(chars, state, step, lambda s: s["t"])


def _characters(places: Column, values: Column, chars: Column) -> Column:
    """Characters of the permuted values, each in the class of the one before."""
    return F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(places[i]["b"] == 1, c).otherwise(F.char(F.ascii(c) - places[i]["v"] + values[i])),
        ),
        "",
    )


def _spaced(like: Column, plain: Column) -> Column:
    """``plain`` with the spaces of ``like``."""
    state = F.struct(F.lit("").alias("t"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        return F.struct(
            F.concat(s["t"], F.when(c == " ", " ").otherwise(plain.substr(s["k"], F.lit(1)))).alias("t"),
            (s["k"] + F.when(c == " ", 0).otherwise(1)).alias("k"),
        )

    return F.aggregate(F.split(like, ""), state, step, lambda s: s["t"])


def _formatted(m: Column, kind: Column, places: Column, v: Column) -> Column:
    d = _digits(m)
    date = F.date_add(F.lit("1900-01-01").cast("date"), v[0] * 4297 + v[1])
    sep = m.substr(5, 1)
    plain = F.regexp_replace(m, " ", "")
    country = F.substring(plain, 1, 2)
    bban = _characters(places, v, F.split(F.substring(plain, 5, 100), ""))
    check = lambda b: F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
    area = v[0] + F.when(v[0] >= 665, 2).otherwise(1)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    nanp = F.concat(F.array(F.lit(1)), F.transform(v, lambda x, i: F.when(i.isin(0, 3), x + 2).otherwise(x)))
    low = v[0] < 20
    area_digit = F.floor(F.when(low, v[0] / 10).otherwise((v[0] - 20) / 2 + 2)).cast("int")
    exchange_digit = F.when(low, v[0] % 10).otherwise((v[0] - 20) % 2)
    odd = F.concat(F.array(F.lit(1), area_digit), F.slice(v, 2, 2), F.array(exchange_digit), F.slice(v, 4, 6))
    card = F.concat(v, F.array(F.lit(0)))
    return (
        F.when(kind == "email", F.concat(_characters(places, v, F.split(F.substring_index(m, "@", 1), "")), F.lit("@"), F.substring_index(m, "@", -1)))
        .when(kind == "ip", F.array_join(F.transform(v, lambda x: x.cast("string")), "."))
        .when(kind == "phone", _refill(m, F.when(d[0] == 1, F.when(_nanp(d), nanp).otherwise(odd)).otherwise(F.concat(F.slice(d, 1, 1), v))))
        .when(kind == "ssn", F.concat_ws("-", pad(area, 3), pad(v[1] + 1, 2), pad(v[2] + 1, 4)))
        .when(
            kind == "date",
            F.when(m.contains("."), F.date_format(date, "dd.MM.yyyy")).otherwise(
                F.concat(F.date_format(date, "yyyy"), sep, F.date_format(date, "MM"), sep, F.date_format(date, "dd"))
            ),
        )
        .when(kind == "iban", let(bban, lambda b: _spaced(m, F.concat(country, check(b), b))))
        .otherwise(let(card, lambda c: _refill(m, F.concat(v, F.array((10 - _luhn(c) % 10) % 10)))))
    )


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, text) of a candidate: its pseudonym, or itself and no kind."""

    def tweak(kind: Column, p: Column) -> Column:
        own = (kind == "phone") & (p[0]["b"] == 36)
        return F.when(own, "phone/1").otherwise(F.concat_ws("/", kind, F.size(p).cast("string")))

    def permuted(kind: Column) -> Column:
        return let(
            places_of(m, kind),
            lambda p: let(feistel(p, tweak(kind, p), key), lambda v: _formatted(m, kind, p, v)),
        )

    return let(
        kind_of(m),
        lambda kind: F.struct(kind.alias("kind"), F.when(kind.isNull(), m).otherwise(permuted(kind)).alias("text")),
    )


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", out: str = "_pseudonymised", counts: str = "_kinds") -> DataFrame:
    """``docs`` with the changed text in ``out`` and the kinds replaced, in order, in ``counts``."""
    text = F.col(text_col)
    asked = text.rlike("[0-9@]")
    found = F.when(asked, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    done = docs.withColumn("_hits", F.transform(found, lambda m: pseudonym(m, key)))
    glued = F.array_join(
        F.zip_with(
            F.split(text, CANDIDATE, -1),
            F.concat(F.transform("_hits", lambda h: h["text"]), F.array(F.lit(""))),
            lambda a, b: F.concat(a, b),
        ),
        "",
    )
    kinds = F.filter(F.transform("_hits", lambda h: h["kind"]), lambda k: k.isNotNull())
    return done.withColumn(out, F.when(F.size("_hits") > 0, glued).otherwise(text)).withColumn(
        counts, F.coalesce(kinds, F.array().cast("array<string>"))
    ).drop("_hits")


def op4_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    done = pseudonymised(docs, "query key")
    count = lambda k: F.size(F.filter("_kinds", lambda x: x == k)).alias(f"n_{k}")
    return done.select("doc_id", F.col("_pseudonymised").alias("text"), F.size("_kinds").alias("n_replaced"), *[count(k) for k in KINDS])
