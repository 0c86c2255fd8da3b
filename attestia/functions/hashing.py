"""Canonical hashes: length-prefixed values, canonical JSON, row-set profiles and keyed digests."""

from __future__ import annotations

import hashlib
import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_part(c: Column) -> Column:
    """`<utf-8 length>:<text>`; null is `-1:`; booleans are their lower-case names."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-1:"))


def canonical_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[canonical_part(v) for v in values]), 256)


def rowset_profile(rows: DataFrame, *columns: str) -> DataFrame:
    """n_rows and the digest of all rows' canonical texts, sorted and joined by line ends.

    The texts are sorted on disk and read by one task in constant memory; `rowset_tree` shares the digest among tasks.
    """
    from attestia.operators.ordered import digest

    line = F.concat_ws("|", *[canonical_part(F.col(c)) for c in columns])
    return digest(rows, line, line, between="\n").select(F.col("n").alias("n_rows"), "digest")


#: Hash digits that name a range of `rowset_tree`: part of the format, 256 ranges.
TREE_DIGITS = 2


def rowset_tree(rows: DataFrame, *columns: str, digits: int = TREE_DIGITS) -> DataFrame:
    """Like `rowset_profile`, shared among tasks: a digest over the digests of hash ranges of the rows.

    `digits` is part of the format and does not follow the table's size: it is returned beside the digest, and two
    digests compare only if it is the same. One digit more divides the ranges by 16; a range is a task's list of hashes, so 2 are
    enough for some 250 million rows and 4 for 64 billion.
    """
    line = F.sha2(F.concat_ws("|", *[canonical_part(F.col(c)) for c in columns]), 256)
    leaves = (
        rows.select(line.alias("line"))
        .groupBy(F.substring("line", 1, digits).alias("range"))
        .agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("leaf"))
    )
    return leaves.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "leaf"))), lambda x: x["leaf"]), "\n"), 256).alias("digest"),
        F.lit(digits).alias("digits"),
    )


class Number(str):
    """A JSON number as it is written."""


def number_text(text: str) -> Number:
    """A JSON number as ECMAScript writes the double that it stands for: 1 for 1.0, 1000 for 1e3, 1e+21 for 1e21."""
    x = float(text)
    if math.isinf(x):
        return Number("null")  # as it is written for what is no finite number
    digits, _, power = f"{abs(x):e}".partition("e") if x == 0 else repr(abs(x)).partition("e")
    whole, _, part = digits.partition(".")
    part = part.rstrip("0")
    point = len(whole) + int(power or 0)
    mantissa = (whole + part).lstrip("0")
    point -= len(whole + part) - len(mantissa)
    mantissa = mantissa.rstrip("0")
    if not mantissa:
        return Number("0")
    n = len(mantissa)
    if n <= point <= 21:
        out = mantissa + "0" * (point - n)
    elif 0 < point <= 21:
        out = f"{mantissa[:point]}.{mantissa[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + mantissa
    else:
        out = mantissa[0] + ("." + mantissa[1:] if n > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return Number("-" + out if x < 0 else out)


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


def json_value(text: str):
    """The value of a JSON text, its numbers as `Number`; raises ValueError if it is no JSON (RecursionError: too deep)."""
    return json.loads(text, parse_float=number_text, parse_int=number_text, parse_constant=_no_number)


def json_text(value, indent: str = "", ordered: bool = False, line: str = "") -> str:
    """A JSON value as text; `indent` lays it out, `ordered` sorts keys by UTF-16 units."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, str):
        return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False))
    if not isinstance(value, (dict, list)):
        return json.dumps(value)
    is_object, inner = isinstance(value, dict), line + indent
    keys = list(value) if is_object else value
    if is_object and ordered:
        keys = sorted(keys, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    colon = ": " if indent else ":"
    parts = [json_text(k) + colon + json_text(value[k], indent, ordered, inner) if is_object else json_text(k, indent, ordered, inner) for k in keys]
    left, right = "{}" if is_object else "[]"
    if not parts:
        return left + right
    if not indent:
        return left + ",".join(parts) + right
    return left + "\n" + ",\n".join(inner + p for p in parts) + "\n" + line + right


def canonical_json(text: str | None) -> str | None:
    """A JSON text with recursively sorted keys, no spaces and numbers in their shortest form; null if it is no JSON.

    Keys sort by UTF-16 units; of keys that repeat the last counts; lone surrogates stay escapes.
    """
    try:
        return json_text(json_value(text), ordered=True)
    except (TypeError, ValueError, RecursionError):
        return None


def _json_digests(texts: pd.Series) -> pd.Series:
    canonical = texts.map(canonical_json)
    return canonical.map(lambda x: None if x is None else hashlib.sha256(x.encode()).hexdigest())


def canonical_json_hash(c: Column) -> Column:
    """Digest of the canonical form of a JSON text; null if it is no JSON."""
    return F.pandas_udf(_json_digests, "string")(c)


def hmac_sha256(c: Column, key: bytes) -> Column:
    """Keyed digest from built-in functions: sha256(outer || sha256(inner || text))."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in block) for x in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(c, "utf-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)
