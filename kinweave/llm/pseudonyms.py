"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their validation are permuted by a keyed Feistel network within their own
format: a card number becomes another number of that length with a right check digit, an address of
four octets another one, a date another date. The same value always becomes the same pseudonym, so it
stays linked across documents. Names in mail addresses and secrets are replaced by keyed digests of
their own shape. Everything is a column expression over one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinweave.llm.common import bound, carried, uncarried

#: What may be personal, by kind; lengths are bounded or taken whole without a way back, so long texts cost linear time.
PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    "local": r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19})(?![0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "iso": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "day": r"(?<![0-9./])(?:[0-9]{1,2}\.[0-9]{1,2}\.|[0-9]{1,2}/[0-9]{1,2}/)[0-9]{4}(?![0-9]|[./][0-9])",
    "address": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?i:password|token|secret|api_key)[ ]{0,2}[=:][ ]{0,2}[\"']?(?:[A-Za-z0-9_+/=~-]|\.(?=[A-Za-z0-9_+/=~-])){8,}+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
ROUNDS = 8
DAYS, EPOCH = 270, 719_162  # dates are permuted in blocks of 270 x 270 days from 0001-01-01


def _digest(key: str, *parts: Column | str) -> Column:
    cols = [F.lit(key)] + [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws("|", *cols), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, kind: Column | str) -> Column:
    """A keyed permutation of the pairs with a < ``size_a`` and b < ``size_b``, as a struct of a and b."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def turn(s: Column, r: Column) -> Column:
        new_a = F.pmod(s["a"] + _number(_digest(key, kind, r, s["b"])), size_a.cast("bigint"))
        new_b = F.pmod(s["b"] + _number(_digest(key, kind, r, s["a"])), size_b.cast("bigint"))
        even = r % 2 == 0
        return F.struct(F.when(even, new_a).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(new_b).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Digit strings to digit strings of the same length (2 to 20)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")
    a, b = F.substr(digits, F.lit(1), half), F.substr(digits, half + 1)
    pair = feistel(a, b, power(half), power(n - half), key, F.concat(F.lit(kind), n.cast("string")))
    return bound(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), half, "0"), F.lpad(p["b"].cast("string"), n - half, "0")))


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled and reduced."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def put(state: Column, c: Column) -> Column:
        is_digit = (c >= "0") & (c <= "9")
        return F.struct(
            F.concat(state["s"], F.when(is_digit, F.substr(digits, state["k"], F.lit(1))).otherwise(c)).alias("s"),
            (state["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(shape, ""), start, put, lambda state: state["s"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _phone(value: Column, key: str) -> Column:
    digits = _digits(value)
    country = F.length(digits) - 10  # the country code stays
    new = F.concat(F.substr(digits, F.lit(1), country), permuted_digits(F.substr(digits, country + 1), key, "phone"))
    return refilled(value, new)


def _card(value: Column, key: str) -> Column:
    def checked(body: Column) -> Column:
        return refilled(value, F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")))

    def valid(digits: Column) -> Column:
        new = bound(permuted_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card"), checked)
        return F.when(luhn_sum(digits) % 10 == 0, new)

    return bound(_digits(value), valid)


def _address(value: Column, key: str) -> Column:
    def valid(octets: Column) -> Column:
        pair = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536), key, "address")
        text = bound(pair, lambda p: F.concat_ws(
            ".", F.floor(p["a"] / 256).cast("string"), (p["a"] % 256).cast("string"),
            F.floor(p["b"] / 256).cast("string"), (p["b"] % 256).cast("string")))
        return F.when(F.forall(octets, lambda o: o <= 255), text)

    return bound(F.transform(F.split(value, r"\."), lambda o: o.cast("int")), valid)


def _date(value: Column, key: str) -> Column:
    """ISO dates, and day-first (else month-first) dates with points or slashes."""
    mark = F.regexp_extract(value, r"^[0-9]{1,2}([./])", 1)
    plain = F.translate(value, ".", "/")

    def moved(day: Column) -> Column:
        index = F.unix_date(day) + EPOCH
        block, inside = F.floor(index / (DAYS * DAYS)), index % (DAYS * DAYS)
        pair = feistel(F.floor(inside / DAYS), inside % DAYS, F.lit(DAYS), F.lit(DAYS), key, F.concat(F.lit("date"), block.cast("string")))
        new = bound(pair, lambda p: F.date_from_unix_date((block * DAYS * DAYS + p["a"] * DAYS + p["b"] - EPOCH).cast("int")))
        return F.when((index >= 0) & (block < 50), new)

    iso = F.date_format(bound(F.try_to_date(value, "yyyy-MM-dd"), moved), "yyyy-MM-dd")
    first, second = F.try_to_date(plain, "d/M/yyyy"), F.try_to_date(plain, "M/d/yyyy")
    wide = F.length(value) == 10
    shown = lambda d, a, b: F.when(wide, F.date_format(d, f"{a}{a}/{b}{b}/yyyy")).otherwise(F.date_format(d, f"{a}/{b}/yyyy"))
    local = F.when(first.isNotNull(), bound(first, lambda d: shown(moved(d), "d", "M"))).otherwise(bound(second, lambda d: shown(moved(d), "M", "d")))
    return F.when(value.rlike(f"^{PATTERNS['iso']}$"), iso).otherwise(F.when(mark == ".", F.translate(local, "/", ".")).otherwise(local))


def _replaced_tail(value: Column, head: str, key: str) -> Column:
    """What follows the pattern ``head``, as a keyed digest of the same length."""
    start = F.regexp_extract(value, head, 0)
    rest = F.length(value) - F.length(start)
    digests = F.transform(F.sequence(F.lit(0), F.floor(rest / 64)), lambda i: _digest(key, "s", i, value))
    return F.concat(start, F.substr(F.array_join(digests, ""), F.lit(1), rest))


def _ssn(value: Column, key: str) -> Column:
    """Numbers of the 898 areas that are given out (001 to 899 without 666), with groups and serials from 1."""
    digits = _digits(value)
    area, group, serial = (F.substr(digits, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
    pair = feistel(area - F.when(area < 666, 1).otherwise(2), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    pad = lambda c, n: F.lpad(c.cast("int").cast("string"), n, "0")
    return bound(pair, lambda p: F.concat_ws(
        "-", pad(p["a"] + F.when(p["a"] < 665, 1).otherwise(2), 3), pad(F.floor(p["b"] / 9999) + 1, 2), pad(p["b"] % 9999 + 1, 4)))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; values that fail their validation stay as they are."""
    kind = lambda *names: value.rlike("^(?:" + "|".join(PATTERNS[n] for n in names) + ")$")
    mail = F.concat(F.lit("u"), F.substring(_digest(key, "mail", F.lower(value)), 1, 12), F.regexp_extract(value, "@.*$", 0))
    secret = F.when(value.startswith("AKIA"), F.concat(F.lit("AKIA"), F.upper(F.substring(_digest(key, "key", value), 1, 16)))).otherwise(
        _replaced_tail(value, "^[A-Za-z_]+ *[=:] *[\"']?", key))
    new = (
        F.when(value.contains("@"), mail)
        .when(kind("phone", "local"), _phone(value, key))
        .when(kind("ssn"), _ssn(value, key))
        .when(kind("card"), _card(value, key))
        .when(kind("iso", "day"), _date(value, key))
        .when(kind("address"), _address(value, key))
        .otherwise(secret)
    )
    return F.coalesce(new, value)


def pseudonymised(docs: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """doc_id, ``keep``, n_found (values replaced) and text of every document.

    A NULL text stays NULL with 0 values, an empty one empty. Repeated rows are handled alike. A column of
    ``keep`` named ``n_found`` gives way to the result's.
    """
    text = F.col("_text")
    plain, names = carried(docs, keep)
    rows = plain.select("doc_id", *names, F.col("text").alias("_text"))
    # One literal test spares most documents the search: every pattern needs a digit, an @ or a key word.
    found = F.when(text.rlike("[0-9@]|AKIA|(?i:password|token|secret|api_key)"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    rows = rows.withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
    rows = rows.withColumn("_new", F.transform("_found", lambda v: pseudonym(v, key)))
    gaps = F.split(text, ANY)
    whole = F.array_join(F.flatten(F.zip_with(gaps, F.col("_new"), lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")
    changed = F.size(F.filter(F.zip_with("_found", "_new", lambda a, b: a != b), lambda x: x))
    out = rows.select("doc_id", changed.cast("bigint").alias("n_found"), F.when(F.size("_found") > 0, whole).otherwise(text).alias("text"), *names)
    return uncarried(out, names)
