"""Format-preserving pseudonyms of personal numbers, dates and addresses, with DataFrame functions only.

Found values are validated (card and account numbers, IBAN by its check number, IPv4 octets, social security
ranges, calendar dates) and permuted within their format by a keyed Feistel network: the characters of a value
are digits of mixed radix, one half is shifted by a hash of the other, eight times. Separators, lengths, case
and check numbers stay valid. Equal values have equal pseudonyms in all documents, with whatever separators numbers are
written, and different values different ones.

What is kept: the domain of a mail address, the country of a phone number or IBAN, and whether a number passes
the Luhn check: one that does not is replaced as well, as it may be mistyped. Dates of 1900 to 2099 stay there; a date
with slashes is day/month/year, unless only month/day/year is a day: then the day of the month stays above 28, if
it is, or from 13 to 28, so that the pseudonym is read in the same way. IBANs, IPv4 octets, social security numbers
and dates that fail their validation are ordinary text, as are dates with the names of months and IPv6 addresses.
A null or empty text stays as it is; repeated rows have the same result, and null keys are rows like others. An empty
table gives no rows. A long text is a row like others. Columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptstrata.llm.common import let

ROUNDS = 8
DIGIT, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Characters of an account number, by country (IBAN registry).
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def iban_pattern() -> str:
    """Account numbers of their country's length, in one piece or in groups of four; else of any length.

    A number ends where its length says, whatever words or numbers follow.
    """

    def body(size: int) -> str:
        groups, rest = divmod(size - 4, 4)
        return rf"(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")

    known = "|".join(rf"(?:{'|'.join(countries.split())})\d{{2}}{body(size)}" for size, countries in IBAN_LENGTHS.items())
    others = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}})(?:(?:{known})(?![A-Za-z0-9])|{others}(?![A-Za-z0-9]))"


# In order of preference where several could begin at the same place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": iban_pattern(),
    "secret": r"(?<![A-Za-z0-9])(?:[a-f0-9]{32,128}|[A-F0-9]{32,128})(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    "date": r"(?<![\d.])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\d-])",
    "number": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)",
}
ANY = "|".join(PATTERNS.values())
# Codes of one and two digits (E.164); all others have three.
COUNTRY_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
FIRST_DAY, DAYS = "1900-01-01", 73_049  # to 2099-12-31; 17 * 4297 days
DAY_RADICES = (17, 4_297)
AREAS, SERIALS = 898, 99 * 9_999  # social security: 001-899 without 666, group 01-99 and serial 0001-9999


def characters(value: Column) -> Column:
    return F.when(F.length(value) > 0, F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(value, i, F.lit(1)))).otherwise(
        F.array().cast("array<string>")
    )


def place(alphabet: str, character: Column) -> Column:
    """1-based place of a character, 0 where it is not in the alphabet."""
    return F.call_function("locate", character, F.lit(alphabet))


def shift(half: Column, place: Column) -> Column:
    """A number from the keyed hash of one half, for one place of the other."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", half, place.cast("string"))), 1, 12), 16, 10).cast("long")


def feistel(values: Column, radices: Column, key: str, kind: str) -> Column:
    """A keyed permutation of mixed-radix numbers (arrays of longs), alternating between the two halves."""
    cut = F.floor(F.size(values) / 2).cast("int")

    def turned(now: Column, turn: Column) -> Column:
        left = turn % 2 == 0
        other = F.array_join(F.transform(F.filter(now, lambda _, j: (j < cut) != left), lambda x: x.cast("string")), ",")
        hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other), 256)
        return let(
            hashed,
            lambda half: F.transform(now, lambda x, j: F.when((j < cut) == left, F.pmod(x + shift(half, j), F.get(radices, j))).otherwise(x)),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, turned)


def permuted(value: Column, key: str, kind: str, alphabets: tuple[str, ...] = (DIGIT,)) -> Column:
    """The string with each character replaced by one of its own alphabet; other characters stay."""
    chars = characters(value)

    def radix(c: Column) -> Column:
        result = F.lit(1)
        for a in alphabets:
            result = F.when(place(a, c) > 0, F.lit(len(a))).otherwise(result)
        return result.cast("long")

    def number(c: Column) -> Column:
        result = F.lit(0)
        for a in alphabets:
            result = F.when(place(a, c) > 0, place(a, c) - 1).otherwise(result)
        return result.cast("long")

    moved = feistel(F.transform(chars, number), F.transform(chars, radix), key, kind)

    def letter(c: Column, v: Column) -> Column:
        result = c
        for a in alphabets:
            result = F.when(place(a, c) > 0, F.substring(F.lit(a), (v + 1).cast("int"), F.lit(1))).otherwise(result)
        return result

    return F.array_join(F.zip_with(chars, moved, letter), "")


def respaced(value: Column, moved: Column, separators: str) -> Column:
    """The characters of `moved` at the places of those of `value` that are no separators."""

    def spaced(new: Column) -> Column:
        def at(c: Column, i: Column) -> Column:
            before = F.regexp_replace(F.substring(value, F.lit(1), i + 1), separators, "")
            return F.when(c.rlike(separators), c).otherwise(F.substring(new, F.length(before), F.lit(1)))

        return F.when(F.length(value) == F.length(new), new).otherwise(F.array_join(F.transform(characters(value), at), ""))

    return let(moved, spaced)


def luhn(digits: Column) -> Column:
    """Luhn sum of the digits, modulo 10; the last one is not doubled."""
    backwards = F.reverse(F.transform(characters(digits), lambda c: c.cast("int")))
    doubled = F.transform(backwards, lambda d, j: F.when(j % 2 == 0, d).when(d < 5, 2 * d).otherwise(2 * d - 9))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10


def number_pseudonym(value: Column, key: str) -> Column:
    """All digits but the last are permuted, and the last keeps the Luhn sum as it was."""
    bare = F.regexp_replace(value, "[^0-9]", "")
    body = permuted(F.substring(bare, F.lit(1), F.length(bare) - 1), key, "number")

    def closed(moved: Column) -> Column:
        last = F.pmod(luhn(bare) - luhn(F.concat(moved, F.lit("0"))), F.lit(10))
        return respaced(value, F.concat(moved, last.cast("string")), "[^0-9]")

    return let(body, closed)


def mod97(text: Column) -> Column:
    """Remainder by 97 of the digits and letters (A is 10, Z is 35) read as one number."""
    return F.aggregate(
        characters(text),
        F.lit(0).cast("long"),
        lambda a, c: F.when(place(DIGIT, c) > 0, (a * 10 + place(DIGIT, c) - 1) % 97).otherwise((a * 100 + place(UPPER, c) + 9) % 97).cast("long"),
    )


def iban_pseudonym(value: Column, key: str) -> Column:
    bare = F.regexp_replace(value, " ", "")
    valid = mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1
    body = permuted(F.substring(bare, F.lit(5), F.length(bare)), key, "iban", (DIGIT, UPPER))
    country = F.substring(value, 1, 2)

    def closed(moved: Column) -> Column:
        rest = mod97(F.concat(moved, country, F.lit("00")))
        return respaced(value, F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), moved), " ")

    return F.when(valid, let(body, closed)).otherwise(value)


def pair_permuted(number: Column, radices: tuple[int, int], key: str, kind: str) -> Column:
    """A number below the product of the radices, permuted as two digits."""
    values = F.array(F.floor(number / radices[1]).cast("long"), (number % radices[1]).cast("long"))
    moved = feistel(values, F.array(*[F.lit(r).cast("long") for r in radices]), key, kind)
    return let(moved, lambda m: F.get(m, F.lit(0)) * radices[1] + F.get(m, F.lit(1)))


def late_day(day: Column, key: str) -> Column:
    """Another day of the same two centuries that is above 12 in its month, as `day` is.

    The days 13 to 28 of all months are one set; the 29th, 30th and 31st of the months that always have them are one
    set each, and so are the 49 leap days.
    """
    year, month, number = F.year(day) - 1900, F.month(day), F.dayofmonth(day)

    def among(months: tuple[int, ...], kind: str) -> Column:
        listed = F.array(*map(F.lit, months))
        index = (year * len(months) + F.array_position(listed, month).cast("int") - 1).cast("long")
        moved = pair_permuted(index, (200, len(months)), key, kind)
        return let(
            moved, lambda m: F.make_date((F.floor(m / len(months)) + 1900).cast("int"), F.get(listed, (m % len(months)).cast("int")), number)
        )

    early = pair_permuted(((year * 12 + month - 1) * 16 + number - 13).cast("long"), (2_400, 16), key, "day 13-28")
    leap = pair_permuted(F.floor((year - 4) / 4).cast("long"), (7, 7), key, "leap day")
    not_february = (1, *range(3, 13))
    return (
        F.when(
            number <= 28,
            let(early, lambda m: F.make_date((F.floor(m / 192) + 1900).cast("int"), (F.floor(m / 16) % 12 + 1).cast("int"), (m % 16 + 13).cast("int"))),
        )
        .when(month == 2, let(leap, lambda m: F.make_date((m * 4 + 1904).cast("int"), F.lit(2), F.lit(29))))
        .when(number == 31, among((1, 3, 5, 7, 8, 10, 12), "day 31"))
        .when(number == 30, among(not_february, "day 30"))
        .otherwise(among(not_february, "day 29"))
    )


def date_pseudonym(value: Column, key: str) -> Column:
    """Another day of the same two centuries, written the same way; day/month/year unless only month/day/year is a day."""
    result = value
    padded = F.length(value) == 10
    formats = [(r"^\d{4}-", "yyyy-MM-dd", None), (r"^\d{4}/", "yyyy/MM/dd", None), (r"^\d{1,2}\.", "d.M.yyyy", "dd.MM.yyyy")]
    slashed = [(r"^\d{1,2}/", "M/d/yyyy", "MM/dd/yyyy"), (r"^\d{1,2}/", "d/M/yyyy", "dd/MM/yyyy")]
    for shape, loose, strict in [*formats, *slashed]:
        day = F.to_date(F.try_to_timestamp(value, F.lit(loose)))
        index = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
        usable = value.rlike(shape) & (index >= 0) & (index < DAYS)
        if loose == "M/d/yyyy":  # other days are day/month/year, which comes next
            usable, moved = usable & (F.dayofmonth(day) > 12), let(day, lambda d: late_day(d, key))
        else:
            moved = F.date_add(F.lit(FIRST_DAY).cast("date"), pair_permuted(index, DAY_RADICES, key, "date").cast("int"))
        written = F.date_format(moved, loose) if strict is None else F.when(padded, F.date_format(moved, strict)).otherwise(F.date_format(moved, loose))
        result = F.when(usable, written).otherwise(result)
    return result


def ssn_pseudonym(value: Column, key: str) -> Column:
    area, group, serial = (F.split(value, "-")[i].cast("long") for i in range(3))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = (area - F.when(area > 666, 2).otherwise(1)) * SERIALS + (group - 1) * 9_999 + serial - 1

    def written(moved: Column) -> Column:
        top, low = F.floor(moved / SERIALS).cast("long"), (moved % SERIALS).cast("long")
        return F.concat_ws(
            "-",
            F.lpad((top + F.when(top >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
            F.lpad((F.floor(low / 9_999) + 1).cast("string"), 2, "0"),
            F.lpad((low % 9_999 + 1).cast("string"), 4, "0"),
        )

    return F.when(valid, let(pair_permuted(index, (AREAS, SERIALS), key, "ssn"), written)).otherwise(value)


def ip_pseudonym(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("long"))
    moved = feistel(octets, F.array(*[F.lit(256).cast("long")] * 4), key, "ip")
    return F.array_join(F.transform(moved, lambda o: o.cast("string")), ".")


def email_pseudonym(value: Column, key: str) -> Column:
    local = F.substring_index(value, "@", 1)
    return F.concat(permuted(local, key, "email", (DIGIT, LOWER, UPPER)), F.lit("@"), F.substring_index(value, "@", -1))


def phone_pseudonym(value: Column, key: str) -> Column:
    """The digits after the country code, which is known by its first digits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    country = F.when(value.startswith("+"), F.regexp_extract(digits, COUNTRY_CODE, 0)).otherwise(F.lit(""))

    def moved(found: Column) -> Column:
        rest = permuted(F.substring(digits, F.length(found) + 1, F.length(digits)), key, "phone")
        return respaced(value, F.concat(found, rest), "[^0-9]")

    return let(country, moved)


def secret_pseudonym(value: Column, key: str) -> Column:
    low = permuted(F.lower(value), key, "secret", ("0123456789abcdef",))
    return F.when(value.rlike("[A-F]"), F.upper(low)).otherwise(low)


PSEUDONYMS = {
    "email": email_pseudonym,
    "iban": iban_pseudonym,
    "secret": secret_pseudonym,
    "ip": ip_pseudonym,
    "date": date_pseudonym,
    "ssn": ssn_pseudonym,
    "phone": phone_pseudonym,
    "number": number_pseudonym,
}


def kind_of(value: Column) -> Column:
    result = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        result = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(result)
    return result


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns, with the pseudonymized text, `n_values` replaced, and their `kinds` in order of place.

    The values and the text between them come from the same pattern, and are put together again in order.
    """

    def replaced(value: Column) -> Column:
        def of_kind(kind: Column) -> Column:
            result = value
            for name, pseudonym in PSEUDONYMS.items():
                result = F.when(kind == name, pseudonym(value, key)).otherwise(result)
            return let(result, lambda new: F.struct(new.alias("text"), F.when(new != value, kind).alias("kind")))

        return let(kind_of(value), of_kind)

    columns = [c for c in docs.columns if c not in ("n_values", "kinds")]
    suspect = F.col(text).rlike("[0-9@]")
    found = docs.select(*columns, F.when(suspect, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("_values"))
    moved = found.withColumn("_new", F.when(F.size("_values") > 0, F.transform("_values", replaced)))
    between = F.split(F.col(text), ANY, -1)
    pieces = F.zip_with(between, F.col("_new")["text"], lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    kinds = F.coalesce(F.filter(F.col("_new")["kind"], lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return moved.select(
        *[F.when(F.col("_new").isNotNull(), F.array_join(pieces, "")).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in columns],
        F.size(kinds).alias("n_values"),
        kinds.alias("kinds"),
    )
