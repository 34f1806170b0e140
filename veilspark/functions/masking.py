"""Masking of single values, as column expressions.

Everything here is a built-in expression tree, so a masked projection stays
on the JVM and adds no shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from veilspark.functions.keys import KEY_VERSION, TokenKeys

# Marks that replace a whole cell, and the patterns behind them.
# (?U) makes \d match every Unicode digit.
ID_MARK = "[已遮掩:疑似证件号]"
BANK_MARK = "[已遮掩:疑似银行卡号]"
PHONE_MARK = "[已遮掩:疑似手机号]"
MARK_PREFIX = "[已遮掩:"
ID_PATTERN = r"(?U)(?<!\d)\d{17}[\dXx](?!\d)"
BANK_PATTERN = r"(?U)(?<!\d)\d{16,19}(?!\d)"
PHONE_PATTERN = r"(?U)(?<!\d)1[3-9]\d{9}(?!\d)"

# Every pattern above needs at least eleven digits in a row.
_DIGIT_RUN = r"(?U)\d{11}"
# Whitespace as the tokeniser counts it: Unicode White_Space plus U+001C..1F.
_SPACES = r"(?U)[\s\x1c-\x1f]+"
_NON_SPACE = r"(?U)[^\s\x1c-\x1f]"
# Anything but printable ASCII with single blanks inside.
_NEEDS_NORMALISING = r"[^\x20-\x7e]|^ | (?: |\z)"


def passthrough(c: Column) -> Column:
    return c


def deny(data_type: T.DataType) -> Column:
    """Null of the column's own type, so that the schema does not change."""
    return F.lit(None).cast(data_type)


@F.pandas_udf(T.StringType())
def _nfkc_python(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def nfkc(c: Column, engine: str = "jvm") -> Column:
    """Unicode NFKC. Spark has no such function of its own.

    ``jvm`` calls the ICU library that ships with Spark, so rows never leave
    the JVM. Spark treats such a call as non-deterministic: it may not stand
    inside an aggregate, and a filter above it is not pushed below it.
    ``python`` uses the interpreter's Unicode tables in an Arrow batch; the two
    differ only for characters newer than the interpreter. ``ascii`` is for
    columns known to hold ASCII only, where there is nothing to compose.
    """
    if engine == "ascii":
        return c
    if engine == "python":
        return _nfkc_python(c)
    return F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True)
    )


def normalize_text(c: Column, engine: str = "jvm") -> Column:
    """NFKC, strip, then squeeze whitespace runs to one space.

    Printable ASCII with single blanks inside is normal already and skips it.
    """
    if engine == "python":
        # A UDF is evaluated for every row; hand it only what it must change.
        odd = F.when(c.rlike(r"[^\x00-\x7f]"), c)
        composed = F.coalesce(nfkc(odd, engine), c)
    else:
        composed = nfkc(c, engine)
    squeezed = F.trim(F.regexp_replace(composed, _SPACES, " "))
    return F.when(c.rlike(_NEEDS_NORMALISING), squeezed).otherwise(c)


def is_placeholder(c: Column, values: Iterable[str]) -> Column:
    """Exact match on the raw value, before any normalising."""
    listed = list(values)
    return c.isin(listed) if listed else F.lit(False)


def tokenize(
    c: Column,
    namespace: str,
    prefix: str,
    keys: TokenKeys,
    placeholders: Iterable[str] = ("",),
    engine: str = "jvm",
) -> Column:
    """Stable keyed token: same value and namespace, same token.

    Nulls, placeholders and blank text come back unchanged.
    """
    message = F.concat(F.lit(f"{namespace}:"), normalize_text(c, engine))
    token = F.concat(F.lit(f"{prefix}_{KEY_VERSION}_"), keys.hmac16(message))
    keep = is_placeholder(c, placeholders) | ~c.rlike(_NON_SPACE)
    return F.when(keep, c).otherwise(token)


def mask_phone(c: Column) -> Column:
    """First three and last four characters; shorter than seven is hidden."""
    shown = F.concat(F.substring(c, 1, 3), F.lit("****"), F.substring(c, -4, 4))
    return F.when(c == "", c).when(F.length(c) < 7, F.lit("***")).otherwise(shown)


def mask_email(c: Column) -> Column:
    """First character and the domain after the last ``@``."""
    domain = F.substring_index(c, "@", -1)
    local_length = F.length(c) - F.length(domain) - 1
    local = F.when(local_length <= 1, F.lit("*")).otherwise(
        F.concat(F.substring(c, 1, 1), F.lit("***"))
    )
    return (
        F.when(c == "", c)
        .when(~c.contains("@"), F.lit("***"))
        .otherwise(F.concat(local, F.lit("@"), domain))
    )


def residual_kind(c: Column) -> Column:
    """``id_card``, ``bank_card``, ``phone`` or null, longest pattern first."""
    kind = (
        F.when(c.rlike(ID_PATTERN), F.lit("id_card"))
        .when(c.rlike(BANK_PATTERN), F.lit("bank_card"))
        .when(c.rlike(PHONE_PATTERN), F.lit("phone"))
    )
    return F.when(c.rlike(_DIGIT_RUN), kind)


def residual_hit(c: Column) -> Column:
    """True when :func:`residual_scan` would replace the value."""
    return F.coalesce(
        c.rlike(_DIGIT_RUN)
        & (c.rlike(ID_PATTERN) | c.rlike(BANK_PATTERN) | c.rlike(PHONE_PATTERN)),
        F.lit(False),
    )


def residual_scan(c: Column) -> Column:
    """Replace the whole cell when it still holds a personal number."""
    scanned = (
        F.when(c.rlike(ID_PATTERN), F.lit(ID_MARK))
        .when(c.rlike(BANK_PATTERN), F.lit(BANK_MARK))
        .when(c.rlike(PHONE_PATTERN), F.lit(PHONE_MARK))
        .otherwise(c)
    )
    # One pass rejects nearly every cell before the three exact patterns run.
    return F.when(c.rlike(_DIGIT_RUN), scanned).otherwise(c)


def holds_text(data_type: T.DataType) -> bool:
    """Whether a value of this type is text or has text in it."""
    if isinstance(data_type, T.ArrayType):
        return holds_text(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(holds_text(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.MapType):
        return holds_text(data_type.keyType) or holds_text(data_type.valueType)
    return isinstance(data_type, T.StringType)


def _field(c: Column, name: str) -> Column:
    return c.getField(name)


def residual_scan_nested(c: Column, data_type: T.DataType) -> Column:
    """:func:`residual_scan` of every text inside arrays, structs and maps, whatever their depth.

    The keys of a map stay apart: a replaced one is followed by its number among the entries.
    """
    if not holds_text(data_type):
        return c
    if isinstance(data_type, T.ArrayType):
        return F.transform(c, lambda x: residual_scan_nested(x, data_type.elementType))
    if isinstance(data_type, T.StructType):
        parts = [residual_scan_nested(_field(c, f.name), f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(data_type, T.MapType):
        scanned = F.transform_values(c, lambda k, v: residual_scan_nested(v, data_type.valueType))
        if not holds_text(data_type.keyType):
            return scanned

        def entry(e: Column, i: Column) -> Column:
            key = residual_scan_nested(e.key, data_type.keyType)
            if isinstance(data_type.keyType, T.StringType):
                key = F.when(key != e.key, F.concat(key, F.lit(" "), (i + 1).cast("string"))).otherwise(e.key)
            return F.struct(key, e.value)

        hit = F.exists(F.map_keys(c), lambda k: residual_hit_nested(k, data_type.keyType))
        return F.when(hit, F.map_from_entries(F.transform(F.map_entries(scanned), entry))).otherwise(scanned)
    return residual_scan(c)


def leaf_texts(c: Column, data_type: T.DataType) -> Column:
    """All texts inside a value, map keys included, as one array; null and other values give none."""
    none = F.array().cast("array<string>")
    if not holds_text(data_type):
        return none
    if isinstance(data_type, T.ArrayType):
        if isinstance(data_type.elementType, T.StringType):
            return F.coalesce(F.array_compact(c), none)
        return F.coalesce(F.flatten(F.transform(c, lambda x: leaf_texts(x, data_type.elementType))), none)
    if isinstance(data_type, T.StructType):
        return F.concat(*[leaf_texts(_field(c, f.name), f.dataType) for f in data_type.fields if holds_text(f.dataType)])
    if isinstance(data_type, T.MapType):
        keys = leaf_texts(F.map_keys(c), T.ArrayType(data_type.keyType))
        return F.concat(keys, leaf_texts(F.map_values(c), T.ArrayType(data_type.valueType)))
    return F.array_compact(F.array(c))


def residual_hit_nested(c: Column, data_type: T.DataType) -> Column:
    """True when :func:`residual_scan_nested` would replace some text of the value."""
    if isinstance(data_type, T.StringType):
        return residual_hit(c)
    return F.exists(leaf_texts(c, data_type), residual_hit)


def hash_id(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))
