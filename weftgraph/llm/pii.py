"""Format-preserving Feistel pseudonyms for personal data in texts (DataFrame operations only).

Values are found by one pattern, validated, and permuted under a key within their own format: digits stay digits, letters
letters of their case, separators stay, card numbers keep a right check digit, addresses and dates stay valid. Each
permutation is a Feistel network, so different values stay different, and equal values in any documents get equal pseudonyms.
What fails validation (a card number with a wrong check digit, a 31st of February) is left alone, and so is all other text.

What is looked for: e-mail addresses, hexadecimal secrets after a word like token or key, IPv4 addresses, ISO dates of the years 1000 to
2999, social security numbers with hyphens, phone numbers with + and country code or in the form (212) 555-0199, and card
numbers. Dates move within their 400 years (1800 to 2199, and the like before and after). Equal phone numbers are linked however they are
spaced, with the country code or, for +1, without it; a trunk zero written in brackets counts as a digit. An e-mail address's local part is linked in
any letter case; its domain stays, as does a phone number's country code. Not found, and so left in clear: other ways to write dates, social
security numbers without hyphens, IBANs, IPv6 addresses, national phone numbers in other forms, names and street addresses.

A document is one row throughout: no shuffle, no table of values, nothing gathered. Texts without a digit or ``@`` are not searched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Kinds and their patterns, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "secret": r"(?<=(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Kk]ey|KEY|[Pp]assword|PASSWORD)[\"']? ?[=:] ?[\"']?)(?:[0-9a-f]{24,128}|[0-9A-F]{24,128})(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z\-])[12][0-9]{3}-[01][0-9]-[0-3][0-9](?![0-9A-Za-z]|-[0-9])",
    "ssn": r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .\-]?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){1,6}(?![0-9])|(?<![0-9A-Za-z+)])\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3})(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Country codes of phone numbers: those of one and two digits; all others have three (fixed values).
COUNTRY = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Days from 1800-01-01 to 2199-12-31 (a cycle of the calendar): 189 times 773.
DAYS, DAYS_A, DAYS_B = 146_097, 189, 773


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _col(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _number(key: str, tag: Column, r: str, part: Column, below: Column) -> Column:
    """A round's keyed number in [0, below) from the other half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.concat(tag, F.lit(r)), part.cast("string")), 256), 1, 14), 16, 10).cast("bigint") % below


def permute_pair(key: str, tag: Column | str, a: Column, b: Column, size_a: Column | int, size_b: Column | int) -> Column:
    """A permutation of the pairs (a, b) with 0 <= a < size_a, 0 <= b < size_b, as struct (a, b)."""
    tag, size_a, size_b = _col(tag), _col(size_a), _col(size_b)

    def step(r: int):
        def both(x: Column) -> Column:
            new_a = (x["a"] + _number(key, tag, f"a{r}", x["b"], size_a)) % size_a
            return let(F.struct(new_a.alias("a"), x["b"].alias("b")), lambda y: F.struct(y["a"].alias("a"), ((y["b"] + _number(key, tag, f"b{r}", y["a"], size_b)) % size_b).alias("b")))

        return both

    return reduce(lambda x, r: let(x, step(r)), range(ROUNDS // 2), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")))


def _shift(text: Column, stream: Column, alphabets: tuple[Column, ...]) -> Column:
    """Each character moved within its alphabet by its place in a stream of hex digits; others stay."""

    def moved(hexes: Column, c: Column, i: Column) -> Column:
        k = F.conv(F.substring(hexes, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 32).cast("int")
        out = c
        for letters in alphabets:
            place = F.instr(letters, c)
            out = F.when(place > 0, F.substring(letters, (place - 1 + k) % F.length(letters) + 1, F.lit(1))).otherwise(out)
        return out

    # The stream is a hash of the other half: made once, not for each character.
    return let(stream, lambda hexes: F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: moved(hexes, c, i)), ""))


def permute_text(key: str, tag: Column | str, text: Column, alphabets: tuple[Column | str, ...] = (DIGITS, LOWER, UPPER)) -> Column:
    """A permutation of the texts with the same character classes in the same places. One character moves by the key alone."""
    tag, alphabets = _col(tag), tuple(map(_col, alphabets))
    half = F.floor(F.length(text) / 2).cast("int")

    def step(r: int):
        def both(x: Column) -> Column:
            stream = lambda n, part: F.sha2(F.concat_ws("|", F.lit(key), F.concat(tag, F.lit(str(n))), part), 256)
            left = F.struct(_shift(x["l"], stream(2 * r, x["r"]), alphabets).alias("l"), x["r"].alias("r"))
            return let(left, lambda y: F.struct(y["l"].alias("l"), _shift(y["r"], stream(2 * r + 1, y["l"]), alphabets).alias("r")))

        return both

    halves = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    return let(reduce(lambda x, r: let(x, step(r)), range(ROUNDS // 2), halves), lambda x: F.concat(x["l"], x["r"]))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, x: acc + x)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, doubling every second from the right."""
    n = F.length(digits)
    return _sum(F.transform(F.sequence(F.lit(1), n), lambda i: let(F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d))))


def _into(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in order."""
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct((acc["n"] + is_digit.cast("int")).alias("n"), F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, step, lambda acc: acc["out"])


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


# Of each kind: what is permuted of a value, null where it is not valid, and the value made of the permuted part. Kinds share networks, told apart by
# their names as tags, so that the plan holds three of them: on texts, on hexadecimal texts and on pairs of numbers.


def _card_part(v: Column) -> Column:
    return let(only_digits(v), lambda d: F.when(luhn_sum(d) % 10 == 0, F.substring(d, F.lit(1), F.length(d) - 1)))


def _card_made(v: Column, body: Column) -> Column:
    return _into(v, F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")))


def _country(v: Column) -> Column:
    """A phone number's + and country code; one without + is of +1."""
    return F.regexp_extract(F.concat(F.when(v.startswith("+"), F.lit("+")).otherwise(F.lit("+1")), only_digits(v)), COUNTRY, 0)


def _phone_part(v: Column) -> Column:
    """The digits after the country code, however they are grouped; 8 to 15 digits make a number."""
    return let(
        F.struct(only_digits(v).alias("d"), F.when(v.startswith("+"), F.length(_country(v)) - 1).otherwise(0).alias("c"), F.when(v.startswith("+"), 0).otherwise(1).alias("one")),
        lambda x: F.when((F.length(x["d"]) + x["one"]).between(8, 15), F.substring(x["d"], x["c"] + 1, F.length(x["d"]))),
    )


def _phone_made(v: Column, national: Column) -> Column:
    code = F.when(v.startswith("+"), F.substring(_country(v), F.lit(2), F.lit(3))).otherwise(F.lit(""))
    return _into(v, F.concat(code, national))


def _email_part(v: Column) -> Column:
    return F.lower(F.substring_index(v, "@", 1))


def _email_made(v: Column, local: Column) -> Column:
    """The permuted local part takes the letter case of the places."""
    cased = let(F.split(F.substring_index(v, "@", 1), ""), lambda old: F.transform(F.split(local, ""), lambda c, i: F.when(F.get(old, i).between("A", "Z"), F.upper(c)).otherwise(c)))
    return F.concat(F.array_join(cased, ""), F.lit("@"), F.substring_index(v, "@", -1))


def _pair(a: Column, b: Column, size_a: int, size_b: int) -> Column:
    return F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), F.lit(size_a).cast("bigint").alias("m"), F.lit(size_b).cast("bigint").alias("n"))


def _ssn_part(v: Column) -> Column:
    area, rest, serial = (F.substring(v, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    good = area.between(1, 899) & (area != 666) & (rest > 0) & (serial > 0)
    return F.when(good, _pair(area - 1 - (area > 666).cast("int"), (rest - 1) * 9999 + serial - 1, 898, 99 * 9999))


def _ssn_made(v: Column, p: Column) -> Column:
    return F.format_string("%03d-%02d-%04d", p["a"] + 1 + (p["a"] >= 665).cast("int"), F.floor(p["b"] / 9999) + 1, p["b"] % 9999 + 1)


def _ip_part(v: Column) -> Column:
    octet = lambda i: F.get(F.split(v, r"\."), F.lit(i)).cast("int")
    return _pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536)


def _ip_made(v: Column, p: Column) -> Column:
    return F.format_string("%d.%d.%d.%d", F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)


def _cycle(v: Column) -> Column:
    return F.floor((F.substring(v, 1, 4).cast("int") - 1800) / 400).cast("int")


def _years_on(date: Column, years: Column) -> Column:
    return F.concat(F.lpad((F.substring(date, 1, 4).cast("int") + years).cast("string"), 4, "0"), F.substring(date, 5, 6))


def _date_part(v: Column) -> Column:
    """The calendar repeats every 400 years, so a date is permuted as the one of 1800 to 2199 in its place."""
    days = F.datediff(F.try_to_date(_years_on(v, -400 * _cycle(v)), "yyyy-MM-dd"), F.lit("1800-01-01").cast("date"))
    return let(days, lambda n: F.when(n.between(0, DAYS - 1), _pair(F.floor(n / DAYS_B), n % DAYS_B, DAYS_A, DAYS_B)))


def _date_made(v: Column, p: Column) -> Column:
    moved = F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), (p["a"] * DAYS_B + p["b"]).cast("int")), "yyyy-MM-dd")
    return let(moved, lambda d: _years_on(d, 400 * _cycle(v)))


def _date(key: str, v: Column) -> Column:
    return let(_date_part(v), lambda x: let(permute_pair(key, "date", x["a"], x["b"], x["m"], x["n"]), lambda p: _date_made(v, p)))


TEXTS = {"card": (_card_part, _card_made), "phone": (_phone_part, _phone_made), "email": (_email_part, _email_made)}
PAIRS = {"ssn": (_ssn_part, _ssn_made), "ip": (_ip_part, _ip_made), "date": (_date_part, _date_made)}
WHOLE = {
    "email": "@", "ip": rf"^(?:{OCTET}\.){{3}}{OCTET}$", "date": "^[12][0-9]{3}-[01][0-9]-[0-3][0-9]$", "ssn": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "phone": r"^[+(]", "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3})$",
}


def kind_of(value: Column) -> Column:
    """The kind of a value that ``ANY`` found. A run of digits may be a card or a secret: it is a card."""
    out = F.lit("secret")
    for kind, pattern in reversed(WHOLE.items()):
        out = F.when(value.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def _by(kind: Column, made: dict[str, Column]) -> Column:
    out = None
    for name, column in made.items():
        out = F.when(kind == name, column) if out is None else out.when(kind == name, column)
    return out


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a found value; null where it is not valid."""
    text = let(_by(kind, {k: part(value) for k, (part, _) in TEXTS.items()}), lambda t: let(permute_text(key, kind, t), lambda new: _by(kind, {k: made(value, new) for k, (_, made) in TEXTS.items()})))
    pair = let(_by(kind, {k: part(value) for k, (part, _) in PAIRS.items()}), lambda x: let(permute_pair(key, kind, x["a"], x["b"], x["m"], x["n"]), lambda p: F.when(p["a"].isNotNull(), _by(kind, {k: made(value, p) for k, (_, made) in PAIRS.items()}))))
    secret = permute_text(key, "secret", value, (F.when(value.rlike("[A-F]"), F.lit(HEX.upper())).otherwise(F.lit(HEX)),))
    return F.when(kind.isin(*TEXTS), text).when(kind.isin(*PAIRS), pair).otherwise(secret)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``, and the columns pii_found (array of (kind, pseudonym)) and n_pii.

    A null or empty text stays and has nothing found. All rows and columns stay, repeated rows too; columns of these two names are
    replaced. Texts of any length are searched whole, in one row's memory.
    """
    text = F.col(text_col)
    searched = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    none = F.array().cast("array<struct<value:string,kind:string,new:string>>")
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda v: let(F.struct(v.alias("value"), kind_of(v).alias("kind")), lambda x: F.struct(x["value"].alias("value"), x["kind"].alias("kind"), pseudonym(x["value"], x["kind"], key).alias("new"))))
    rows = docs.withColumn("pii_found", F.when(searched, found).otherwise(none))
    between = F.split(text, ANY, -1)
    joined = F.array_join(F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.get("pii_found", i)["new"], F.get("pii_found", i)["value"], F.lit("")))), "")
    rows = rows.withColumn(text_col, F.when(F.size("pii_found") > 0, joined).otherwise(text))
    valid = F.filter("pii_found", lambda x: x["new"].isNotNull())
    rows = rows.withColumn("pii_found", F.transform(valid, lambda x: F.struct(x["kind"].alias("kind"), x["new"].alias("pseudonym"))))
    return rows.withColumn("n_pii", F.size("pii_found").cast("bigint"))
