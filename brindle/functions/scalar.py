"""Scalar column helpers whose semantics differ from plain Spark, and thin wrappers that name the right builtin.

Everything here builds Column trees, except NFC normalisation and CRC32C, for which Spark has no builtin.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def divide(df: DataFrame, a: str, b: str) -> Column:
    """a / b as the engine defines it: integers truncate towards zero, anything else is a double; zero is an error."""
    kinds = dict(df.dtypes)
    if kinds[a] in INTEGRAL and kinds[b] in INTEGRAL:
        return F.expr(f"`{a}` div `{b}`")
    return F.col(a).cast("double") / F.col(b).cast("double")


def float_sum(c: Column | str) -> Column:
    """SUM always gives a double, also over integers; null on no rows."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("double"))


def count_all(*cols: str) -> Column:
    """COUNT(x, y, ...): the non-null values of all arguments together."""
    total = F.count(cols[0])
    for c in cols[1:]:
        total = total + F.count(c)
    return total


def ascending(c: str) -> Column:
    return F.col(c).asc_nulls_last()


def descending(c: str) -> Column:
    return F.col(c).desc_nulls_first()


def two_valued(c: Column) -> Column:
    """The legacy reading of a predicate: null counts as false."""
    return F.coalesce(c, F.lit(False))


def like_pattern(pattern: str) -> str:
    r"""A LIKE pattern that Spark accepts: a backslash that escapes nothing stands for itself."""
    return re.sub(r"\\([%_\\])|\\", lambda m: m[0] if m[1] else "\\\\", pattern)


def like(c: Column, pattern: str) -> Column:
    return c.like(like_pattern(pattern))


def ilike(c: Column, pattern: str) -> Column:
    return c.ilike(like_pattern(pattern))


def glob_regex(glob: str) -> str:
    """``*`` is any run, ``?`` one character, all else itself; anchored."""
    return "^(?s:" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + ")$"


def glob_match(c: Column, glob: str) -> Column:
    return c.rlike(glob_regex(glob))


def cast_to(c: Column, source: str, target: str) -> Column:
    """The engine's cast matrix. source and target: boolean, bigint, double or string; what is outside it is an error.

    Text is parsed strictly (no surrounding spaces); text is true for true, 1 and yes, false for false, 0 and no;
    whole doubles print without a fraction; doubles truncate to integers.
    """
    if source == target:
        return c
    if target == "string":
        if source == "double":
            whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
            return F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
        return c.cast("string")
    if source == "string":
        if target == "boolean":
            low = F.lower(c)
            bad = F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean")
            return F.when(c.isNull(), None).when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False).otherwise(bad)
        bad = F.raise_error(F.concat(F.lit("not a number: "), c)).cast(target)
        return F.when(c.isNull() | c.rlike(r"^[^\s]+$"), c.cast(target)).otherwise(bad)
    if (source, target) in {("bigint", "double"), ("double", "bigint"), ("bigint", "boolean")}:
        return c.cast(target)
    raise TypeError(f"no cast from {source} to {target}")


def json_get(payload: Column, path: list[str]) -> Column:
    """The value at a path of object keys; null where there is none."""
    return F.get_json_object(payload, "$" + "".join(f"['{p}']" for p in path))


def get_path(c: str, path: str) -> Column:
    """A dotted path in a struct column."""
    out = F.col(c)
    for p in path.split("."):
        out = out.getField(p)
    return out


def set_path(c: str, path: str, value: Column) -> Column:
    """The struct c with the dotted path set; a missing intermediate struct is an analysis error."""
    return F.col(c).withField(path, value)


def remove_path(c: str, path: str) -> Column:
    return F.col(c).dropFields(path)


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


@F.pandas_udf(T.StringType())
def nfc(texts):
    """Unicode normal form C."""
    return texts.map(lambda s: s if s is None else unicodedata.normalize("NFC", s))


def _crc32c_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


_CRC32C = _crc32c_table()


def crc32c_bytes(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = _CRC32C[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


@F.pandas_udf(T.LongType())
def crc32c(data):
    """CRC-32C (Castagnoli) of a binary column."""
    return data.map(lambda b: None if b is None else crc32c_bytes(bytes(b))).astype("Int64")


def unify(a: str, b: str) -> str:
    """The common type of two: null gives way, numbers widen to double, a number beside text stays a number."""
    if a == b or b == "void":
        return a
    if a == "void":
        return b
    numbers = {"bigint", "double"}
    if {a, b} <= numbers:
        return "double"
    if "string" in (a, b) and numbers & {a, b}:
        return a if a in numbers else b
    raise TypeError(f"{a} and {b} have no common type")

