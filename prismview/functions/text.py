"""Text, hash and format expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without comments (an unescaped % to the end of its line), white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?m)(?<!\\)%.*$", ""), r"\s+", " "))


def holds(text: Column, excerpt: Column) -> Column:
    return F.contains(stripped(text), stripped(excerpt))


def key_numbers(text: Column) -> Column:
    """Map of the ``key = number`` pairs in a text."""
    pattern = F.lit(r"(\w+)\s*[=:]\s*([-+]?\d+(?:\.\d+)?)")
    keys, values = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    return F.map_from_entries(F.filter(F.transform(keys, lambda k, i: F.when(F.array_position(keys, k) == i + 1, F.struct(k, F.get(values, i).cast("double")))), lambda e: e.isNotNull()))


def text_of_index(index: Column) -> Column:
    """An inverted index (map word -> places) back to text."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")


def order_hash(df: DataFrame, rank: str, key: str, block: int = 4096) -> DataFrame:
    """One row: a SHA-1 that changes if any key or the order changes, from hashes of blocks of rows."""
    blocks = df.groupBy(F.floor(F.col(rank) / block).alias("b")).agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, F.col(key).cast("string").alias("k")))), lambda x: x["k"]), "\n")).alias("h"))
    return blocks.agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n")).alias("order_hash"))


def with_minus(x: Column, digits: int) -> Column:
    """Fixed digits with a typographic minus."""
    return F.regexp_replace(F.format_number(x, digits), "^-", "−")


def percent(share: Column) -> Column:
    """Percent with digits that fit its size: none from 10 on, one from 1 on, two below."""
    p = share * 100
    return F.when(p >= 10, F.format_number(p, 0)).when(p >= 1, F.format_number(p, 1)).otherwise(F.format_number(p, 2))


def ordinal(n: Column) -> Column:
    teen = (n % 100).between(11, 13)
    end = F.when(~teen & (n % 10 == 1), "st").when(~teen & (n % 10 == 2), "nd").when(~teen & (n % 10 == 3), "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def vector_text(v: Column) -> Column:
    """base64url text of a vector in -1..1, as little-endian 16-bit numbers, without padding."""
    def two_bytes(x):
        q = F.greatest(F.lit(-32767), F.least(F.lit(32767), F.floor(x.cast("double") * 32767 + 0.5))).cast("long")
        return F.concat(F.lpad(F.hex(q.bitwiseAND(F.lit(255))), 2, "0"), F.lpad(F.hex(F.shiftright(q.bitwiseAND(F.lit(65535)), 8)), 2, "0"))

    return F.rtrim(F.translate(F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(v, two_bytes), ""))), r"\s", ""), "+/=", "-_ "))


def vector_of(text: Column, size: int | None = None) -> Column:
    """The 16-bit numbers of vector_text, with zeros up to size for dimensions that came later."""
    whole = F.rpad(F.translate(text, "-_", "+/"), F.ceil(F.length(text) / 4).cast("int") * 4, "=")
    h = F.hex(F.unbase64(whole))
    at = lambda i: F.conv(F.concat(F.substring(h, i * 4 + 3, F.lit(2)), F.substring(h, i * 4 + 1, F.lit(2))), 16, 10).cast("long")
    n = F.floor(F.length(h) / 4).cast("int")
    out = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(at(i) > 32767, at(i) - 65536).otherwise(at(i))))
    return out if size is None else F.concat(out, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(0), size - n)))
