"""Format-preserving pseudonyms for personal data: keyed Feistel permutations of validated numbers and dates.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: What is looked for; RUN and the order of the passes are below. A match begins where its kind of characters do and takes
#: them whole, so that a long run is read once. A host name has 127 labels at most.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++(?<!\.)@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+",
    "date": r"(?<![0-9-])(?:1[7-9][0-9]{2}|20[0-9]{2})-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
#: Numbers with single spaces or hyphens between them, as far as they go, and with digits enough for a card.
RUN = r"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){12})[0-9]+(?:[ -][0-9]+)*+"
#: How card numbers are usually written, with a space for either separator.
USUAL = r"^(?:[3-6]|2(?=[2-7]))(?:[0-9]{12,18}|[0-9]{3}(?: [0-9]{4}){2} [0-9]{1,4}|[0-9]{3}(?: [0-9]{4}){3} [0-9]{1,3}|[0-9]{3} [0-9]{6} [0-9]{4,5})$"
#: Days of the Gregorian cycle of 400 years, which starts on this day, as 189 * 773.
FIRST_DAY, DAYS = "1700-01-01", (189, 773)
ROUNDS = 10


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def feistel(number: Column, left: Column | int, right: Column | int, key: str, tweak: str) -> Column:
    """A keyed permutation of the numbers below ``left * right``: the halves take turns in adding a digest of the other."""
    left, right = (x if isinstance(x, Column) else F.lit(x) for x in (left, right))
    left, right = left.cast("long"), right.cast("long")

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        seen, other, size = F.when(even, acc["b"]).otherwise(acc["a"]), F.when(even, acc["a"]).otherwise(acc["b"]), F.when(even, left).otherwise(right)
        digest = F.sha2(F.concat_ws("/", F.lit(key), F.lit(tweak), i.cast("string"), size.cast("string"), seen.cast("string")), 256)
        more = F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")
        new = F.pmod(other + more, size)
        return F.struct(F.when(even, new).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(new).alias("b"))

    start = F.struct(F.floor(number / right).cast("long").alias("a"), F.pmod(number, right).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: acc["a"] * right + acc["b"])


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def refill(match: Column, digits: Column) -> Column:
    """``match`` with its digits replaced in order."""
    marks = F.transform(F.sequence(F.lit(1), F.length(match)), lambda i: match.substr(i, F.lit(1)))
    is_digit = lambda c: c.rlike("[0-9]")

    def step(acc: Column, c: Column) -> Column:
        n = acc["n"] + F.when(is_digit(c), 1).otherwise(0)
        return F.struct(F.concat(acc["s"], F.when(is_digit(c), digits.substr(n, F.lit(1))).otherwise(c)).alias("s"), n.alias("n"))

    return F.aggregate(marks, F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), step, lambda acc: acc["s"])


def permuted(digits: Column, key: str, tweak: str) -> Column:
    """Digits permuted among all digit strings of their length, 2 to 18."""
    n = F.length(digits)
    power = lambda m: F.pow(F.lit(10.0), m).cast("long")
    half = F.floor(n / 2).cast("int")
    return F.lpad(feistel(digits.cast("long"), power(n - half), power(half), key, tweak).cast("string"), n, "0")


def social(number: Column, key: str) -> Column:
    """Nine digits permuted among valid numbers: area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (number.substr(F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    place = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1

    def told(x: Column) -> Column:
        area = F.floor(x / (99 * 9999)) + 1
        parts = (area + (area >= 666).cast("long"), F.pmod(F.floor(x / 9999), F.lit(99)) + 1, F.pmod(x, F.lit(9999)) + 1)
        return F.concat(*(F.lpad(p.cast("string"), n, "0") for p, n in zip(parts, (3, 2, 4), strict=True)))

    return _let(feistel(place, 898 * 99, 9999, key, "ssn"), told)


def phone(number: Column, key: str) -> Column:
    """Ten digits permuted among those whose area and exchange begin with 2 to 9."""
    area, exchange, line = (number.substr(F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
    place = ((area - 200) * 800 + exchange - 200) * 10_000 + line
    parts = lambda x: (F.floor(x / 8_000_000) + 200, F.pmod(F.floor(x / 10_000), F.lit(800)) + 200, F.pmod(x, F.lit(10_000)))
    told = lambda x: F.concat(*(F.lpad(p.cast("string"), n, "0") for p, n in zip(parts(x), (3, 3, 4), strict=True)))
    return _let(feistel(place, 80_000, 80_000, key, "phone"), told)


def luhn(digits: Column) -> Column:
    """The sum whose last digit is 0 for a valid card number."""
    n = F.length(digits)
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _doubled(digits.substr(n - i, F.lit(1)).cast("int"), i % 2 == 1))
    return F.aggregate(at, F.lit(0), lambda a, x: a + x)


def _doubled(d: Column, double: Column) -> Column:
    return F.when(double, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)


def card(digits: Column, key: str) -> Column:
    """All digits but the last permuted, the last one set to keep the number valid."""
    n = F.length(digits)
    body = permuted(digits.substr(F.lit(1), n - 1), key, "card")
    return _let(body, lambda b: F.concat(b, F.pmod(-luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))


SEGMENT = "struct<kind:string,text:string>"


def _segment(kind: Column | None, text: Column) -> Column:
    return F.struct((F.lit(None).cast("string") if kind is None else kind).alias("kind"), text.alias("text"))


def cut(segments: Column, pattern: str, within) -> Column:
    """``segments`` (kind, text) in which each match of ``pattern`` in text of no kind gives way to the segments ``within(match)``."""

    def pieces(text: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))
        none = F.array().cast(f"array<{SEGMENT}>")
        join = lambda gap, hit: F.concat(F.array(_segment(None, gap)), F.when(hit.isNull(), none).otherwise(within(hit)))
        return F.flatten(F.zip_with(F.split(text, pattern, -1), hits, join))

    taken = lambda s: s["kind"].isNotNull() | ~s["text"].rlike(pattern)
    return F.flatten(F.transform(segments, lambda s: F.when(taken(s), F.array(s)).otherwise(pieces(s["text"]))))


def card_segments(run: Column, usual: bool) -> Column:
    """A run of numbers as segments: from left to right, the longest row of whole numbers that is a valid card, and what is between.

    With ``usual``, only rows that look like a card count.
    """

    def of(row: Column) -> Column:
        numbers, marks = row["numbers"], row["marks"]
        n = F.size(numbers)

        def is_card(i: Column, j: Column) -> Column:
            part = F.slice(numbers, i + 1, j - i + 1)
            size = F.aggregate(part, F.lit(0), lambda a, x: a + F.length(x))
            valid = F.when(size.between(13, 19), F.pmod(luhn(F.array_join(part, "")), F.lit(10)) == 0)
            return F.when(F.array_join(part, " ").rlike(USUAL), valid) if usual else valid

        # a card has at most 19 numbers
        last = lambda i: F.array_max(F.filter(F.sequence(i, F.least(n - 1, i + 18)), lambda j: is_card(i, j)))
        ends = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), last(i).alias("j")))
        start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<i:int,j:int>>").alias("picks"))
        take = lambda acc, e: F.struct((e["j"] + 1).alias("free"), F.array_append(acc["picks"], e).alias("picks"))
        picks = F.aggregate(F.filter(ends, lambda e: e["j"].isNotNull()), start, lambda acc, e: F.when(e["i"] >= acc["free"], take(acc, e)).otherwise(acc), lambda acc: acc["picks"])

        def written(i: Column, j: Column) -> Column:
            """Numbers i to j with the marks between them."""
            return F.array_join(F.transform(F.sequence(i, j), lambda k: F.concat(numbers[k], F.when(k < j, marks[k]).otherwise(""))), "")

        def parts(p: Column) -> Column:
            before = F.when(p["from"] < p["i"], F.concat(written(p["from"], p["i"] - 1), marks[p["i"] - 1])).otherwise("")
            after = F.when(p["j"] < n - 1, marks[F.least(p["j"], n - 2)]).otherwise("")
            return F.array(_segment(None, before), _segment(F.lit("card"), written(p["i"], p["j"])), _segment(None, after))

        def laid_out(found: Column) -> Column:
            froms = F.transform(found, lambda p, k: F.struct(F.when(k > 0, F.get(found, k - 1)["j"] + 1).otherwise(0).alias("from"), p["i"].alias("i"), p["j"].alias("j")))
            end = F.element_at(found, -1)["j"] + 1
            tail = F.when(end < n, written(end, n - 1)).otherwise("")
            return F.concat(F.flatten(F.transform(froms, parts)), F.array(_segment(None, tail)))

        return _let(picks, lambda found: F.when(F.size(found) > 0, laid_out(found)).otherwise(F.array(_segment(None, run))))

    return _let(F.struct(F.split(run, "[ -]").alias("numbers"), F.regexp_extract_all(run, F.lit("([ -])"), F.lit(0)).alias("marks")), of)


def found(text: Column) -> Column:
    """``text`` as segments of a kind, or of none, in order.

    Kinds are looked for one after the other, so that what fails validation hides nothing. Cards that look like
    one go before phone numbers, all others after them.
    """
    segments = F.array(_segment(None, text))
    for kind in ("email", "date", "ip", "ssn"):
        valid = (lambda m: F.when(F.try_to_date(m).isNotNull(), "date")) if kind == "date" else (lambda m, k=kind: F.lit(k))
        segments = cut(segments, PATTERNS[kind], lambda m, v=valid: F.array(_segment(v(m), m)))
    segments = cut(segments, RUN, lambda m: card_segments(m, True))
    segments = cut(segments, PATTERNS["phone"], lambda m: F.array(_segment(F.lit("phone"), m)))
    return cut(segments, RUN, lambda m: card_segments(m, False))


def pseudonym(match: Column, kind: Column, key: str) -> Column:
    """What stands in for a match: of the same format, and the same wherever the same value stands."""
    email = F.sha2(F.concat_ws("/", F.lit(key), F.lit("email"), F.lower(match)), 256)
    octets = F.split(match, r"\.")
    address = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    moved = feistel(address, 1 << 16, 1 << 16, key, "ip")
    ip = _let(moved, lambda x: F.concat_ws(".", *(F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0))))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(F.datediff(F.try_to_date(match), F.lit(FIRST_DAY).cast("date")).cast("long"), *DAYS, key, "date").cast("int"))
    number = digits_of(match)
    # a phone number keeps what precedes its last ten digits
    dialled = F.concat(number.substr(F.lit(1), F.length(number) - 10), phone(number.substr(F.length(number) - 9, F.lit(10)), key))
    return (
        F.when(kind == "email", F.concat(F.lit("p"), F.substring(email, 1, 16), F.lit("@example.invalid")))
        .when(kind == "date", day.cast("string"))
        .when(kind == "ip", ip)
        .when(kind == "ssn", refill(match, social(number, key)))
        .when(kind == "phone", refill(match, dialled))
        .when(kind == "card", refill(match, card(number, key)))
        .otherwise(match)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised, and ``out_col`` array<struct<kind, value>>: each stand-in in order.

    Found: e-mail addresses, IPv4 addresses, dates (ISO, 1700 to 2099), social security numbers, phone numbers
    and card numbers with a valid check digit. Numbers and dates move within their format by a permutation under
    ``key``, so that equal values stay linked across documents and distinct ones stay distinct; e-mail
    addresses become keyed digests. Numbers that fail validation stay, and what is valid next to them is found: a card
    is any row of whole numbers, apart by single spaces or hyphens, with 13 to 19 digits and a valid check digit. A null
    text stays null, with no finds. All rows and columns stay; an own column ``out_col`` is replaced. Social security numbers
    of area 000, 666 or 900 and above, group 00 or serial 0000, and phone numbers whose area or exchange begins with 0 or 1,
    are none; who has ``key`` can undo the permutations.
    """
    text, spare = F.col(text_col), unused(docs, "found")
    rows = docs.withColumn(spare, F.when(text.rlike("[0-9@]"), found(text)))
    made = F.transform(spare, lambda s: F.struct(s["kind"].alias("kind"), pseudonym(s["text"], s["kind"], key).alias("value")))
    rows = rows.withColumn(spare, made)
    rows = rows.withColumn(text_col, F.when(F.col(spare).isNull(), text).otherwise(F.array_join(F.transform(spare, lambda s: s["value"]), "")))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return rows.withColumn(out_col, F.coalesce(F.filter(spare, lambda s: s["kind"].isNotNull()), none)).drop(spare)
