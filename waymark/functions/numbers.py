"""Prices, intervals, hashes and rounding, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The zero of each script's decimal digits.
ZEROES = (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0E50, 0x0ED0, 0x0F20, 0xFF10)
DIGITS = "".join(chr(z + d) for z in ZEROES for d in range(10))
VALUES = "0123456789" * len(ZEROES)


def places(x: Column, n: int) -> Column:
    """x to n decimals, halves up, the same in every engine that follows IEEE arithmetic."""
    return F.floor(x * F.lit(float(10**n)) + 0.5) / F.lit(float(10**n))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row, however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def price_number(text: Column) -> Column:
    """A printed number as a plain one, or null.

    With both separators the last one is decimal. A single kind of separator is decimal before one or two last digits, unless
    every group after the first has three digits; otherwise it groups thousands. A fraction has two digits at most.
    """

    def read(plain: Column) -> Column:
        tail = F.regexp_extract(plain, r"[,.](\d*)$", 1)
        both = plain.contains(",") & plain.contains(".")
        last = F.regexp_extract(plain, r"([,.])\d*$", 1)
        grouped = plain.rlike(r"^\d+([,.]\d{3})+$")
        decimal = (last != "") & (both | (~grouped & F.length(tail).isin(1, 2)))
        whole = F.regexp_replace(F.when(decimal, F.regexp_replace(plain, r"[,.]\d*$", "")).otherwise(plain), "[,.]", "")
        value = F.when(decimal & (tail != ""), F.concat(whole, F.lit("."), tail)).otherwise(whole)
        return F.when(plain.rlike(r"^\d[\d,.]*$") & (~decimal | (F.length(tail) <= 2)), value)

    plain = F.translate(F.regexp_replace(F.translate(F.trim(text), DIGITS, VALUES), r"[\s'’]", ""), "٬٫", ",.")
    return bound(plain, read)


def published_price(text: Column) -> Column:
    """struct(text, currency, price, status): the first word of three capitals is the currency, the number follows it."""

    def result(found: Column) -> Column:
        source, currency, number = found["source"], found["currency"], found["number"]
        missing = source.isNull() | (source == "")
        verified = ~missing & (currency != "") & number.isNotNull()
        return F.struct(
            F.when(~missing, source).alias("text"),
            F.when(verified, currency).alias("currency"),
            F.when(verified, number).alias("price"),
            F.when(missing, "missing").when(verified, "verified").otherwise("unparsed").alias("status"),
        )

    source = F.trim(text)
    parts = r"(?s)^.*?\b([A-Z]{3})\b[^\p{N}]*(\p{N}[\p{N}\s.,'’٬٫]*)?"
    number = price_number(F.regexp_extract(source, parts, 2)).try_cast("double")
    return bound(F.struct(source.alias("source"), F.regexp_extract(source, parts, 1).alias("currency"), number.alias("number")), result)


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high): the score interval of k of n, within 0 and 1, to four decimals; null if n <= 0."""
    n = F.when(n > 0, n)
    p, zz = k / n, z * z
    centre, spread = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    bound = lambda x: F.when(n.isNotNull(), places(F.least(F.greatest(x / (1 + zz / n), F.lit(0.0)), F.lit(1.0)), 4))
    return F.struct(bound(centre - spread).alias("low"), bound(centre + spread).alias("high"))


def derived_price_consistent(text: Column, currency: Column, price: Column, status: Column) -> Column:
    """A verified price has its text, currency and a positive amount; any other has neither currency nor amount."""
    amount = (price > 0) & ~F.isnan(price) & (price < float("inf"))
    whole = (F.trim(F.coalesce(text, F.lit(""))) != "") & (F.coalesce(currency, F.lit("")) != "") & F.coalesce(amount, F.lit(False))
    return F.when(status == "verified", whole).otherwise(price.isNull() & currency.isNull())


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points, as a long."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)


def severity_cost(severities: Column) -> Column:
    """100 for each error, 10 for each warning and 1 for any other."""
    cost = lambda s: F.when(s == "error", 100).when(s == "warning", 10).otherwise(1)
    return F.aggregate(severities, F.lit(0), lambda total, s: total + cost(s))


def cheapest_of_one_currency(offers: Column) -> Column:
    """struct(text, currency, price) of an array of structs (text, currency, price, status).

    If the verified offers have exactly one currency, the cheapest, the first of equals; else the first published text.
    """
    published = F.filter(offers, lambda o: F.coalesce(o["text"], F.lit("")) != "")
    verified = F.filter(published, lambda o: o["status"] == "verified")
    one = F.size(F.array_distinct(F.transform(verified, lambda o: o["currency"]))) == 1
    ranked = F.array_min(F.transform(verified, lambda o, i: F.struct(o["price"].alias("price"), i.alias("i"), o["text"].alias("text"), o["currency"].alias("currency"))))
    return F.struct(
        F.when(one, ranked["text"]).otherwise(F.get(published, F.lit(0))["text"]).alias("text"),
        F.when(one, ranked["currency"]).alias("currency"),
        F.when(one, ranked["price"]).alias("price"),
    )
