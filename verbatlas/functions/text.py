"""Tokens, prefixes, deletions and canonical values as column expressions, with their Python twins."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space, spelt out: \s of the regex dialects in use differs.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: The same for Spark: one class of Java's, several times faster than a list of ranges.
_SPARK_SPACE = r"\p{IsWhite_Space}+"
_SPACE = re.compile("[\t\n\x0b\f\r \x85\xa0  -     　]+")
STOP_WORDS = ("a", "the", "and")


def tokens(text: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Lower-case words with all but a-z and 0-9 deleted, without empty ones and stop words."""
    words = F.transform(F.split(F.lower(text), _SPARK_SPACE), lambda w: F.regexp_replace(w, "[^a-z0-9]+", ""))
    stop = tuple(stop_words)
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop) if stop else w != "")


def tokenize(text: str, stop_words: Iterable[str] = STOP_WORDS) -> list[str]:
    words = (re.sub("[^a-z0-9]+", "", w) for w in _SPACE.split(text.lower()))
    stop = set(stop_words)
    return [w for w in words if w and w not in stop]


def field_tokens(df: DataFrame, fields: Iterable[str], stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Tokens of all text fields in order; strings and arrays of strings count, other and absent fields don't."""
    parts = []
    kinds = {f.name: f.dataType for f in df.schema.fields}
    empty = F.array().cast("array<string>")
    for name in fields:
        kind = kinds.get(name)
        col = F.col(f"`{name}`")
        if isinstance(kind, T.StringType):
            parts.append(F.coalesce(tokens(col, stop_words), empty))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            parts.append(F.coalesce(F.flatten(F.transform(F.filter(col, lambda x: x.isNotNull()), lambda x: tokens(x, stop_words))), empty))
        elif isinstance(kind, T.VariantType):
            text, texts = F.try_variant_get(col, "$", "string"), F.try_variant_get(col, "$", "array<variant>")
            kind_of = F.schema_of_variant(col)
            one = F.when(kind_of == "STRING", tokens(text, stop_words))
            many = F.flatten(F.transform(F.filter(texts, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: tokens(F.try_variant_get(x, "$", "string"), stop_words)))
            parts.append(F.coalesce(one, many, empty))
    return F.concat(*parts) if parts else empty


def worded(df: DataFrame, fields: Iterable[str], stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Whether the fields have tokens; texts with a run longer than every stop word need not be cut for that."""
    fields, run = tuple(fields), f"[A-Za-z0-9]{{{1 + max(map(len, stop_words), default=0)}}}"
    kinds = {f.name: f.dataType for f in df.schema.fields}
    sure = F.lit(False)
    for name in fields:
        if isinstance(kinds.get(name), T.StringType):
            sure = sure | F.coalesce(F.col(f"`{name}`").rlike(run), F.lit(False))
    return F.when(sure, True).otherwise(F.size(field_tokens(df, fields, stop_words)) > 0)


def unit_score(count: Column) -> Column:
    """100000 over the number of tokens, in whole numbers; null without tokens."""
    return F.floor(F.lit(100000) / F.nullif(count, F.lit(0))).cast("bigint")


def prefixes(term: Column) -> Column:
    """Proper prefixes, shortest first."""
    return F.when(F.length(term) >= 2, F.transform(F.sequence(F.lit(1), F.length(term) - 1), lambda i: F.left(term, i))).otherwise(F.array().cast("array<string>"))


def deletions(term: Column) -> Column:
    """The term without each of its characters in turn; none for terms shorter than 2."""
    cut = F.transform(F.sequence(F.lit(1), F.length(term)), lambda i: F.concat(F.left(term, i - 1), F.substr(term, i + 1)))
    return F.when(F.length(term) >= 2, cut).otherwise(F.array().cast("array<string>"))


def deletion_keys(term: Column) -> Column:
    """The term itself, then its deletions."""
    return F.concat(F.array(term), deletions(term))


def deletion_keys_of(term: str) -> list[str]:
    return [term, *(term[:i] + term[i + 1 :] for i in range(len(term)) if len(term) > 1)]


def _plain(number: Column) -> Column:
    whole = number == F.floor(number)
    return F.when(whole & (F.abs(number) < 1e37), number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))


def _go(number: Column) -> Column:
    """Shortest digits, with an exponent below 1e-4 and from a million on."""
    text = F.abs(number).cast("string")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "E.*$", ""), "[.]", ""), "^0+", "")
    digits = F.regexp_replace(digits, "0+$", "")
    exponent = F.floor(F.log10(F.abs(number))).cast("int")
    exponent = F.when(F.pow(F.lit(10.0), exponent + 1) <= F.abs(number), exponent + 1).otherwise(exponent)
    mantissa = F.concat(F.left(digits, F.lit(1)), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""))
    sign = F.when(number < 0, "-").otherwise("")
    shown = F.concat(sign, mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return F.when((number != 0) & ((F.abs(number) >= 1e6) | (F.abs(number) < 1e-4)), shown).otherwise(_plain(number))


def canonical(df: DataFrame, name: str, go_float_format: bool = False) -> Column | None:
    """A filter value as text, so that 2020, 2020.0 and "2020" are one; None for kinds that can't be filtered on."""
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return col
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return col.cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (_go if go_float_format else _plain)(col.cast("double"))
    if isinstance(kind, T.VariantType):
        of = F.schema_of_variant(col)
        number = F.try_variant_get(col, "$", "double")
        shown = (_go if go_float_format else _plain)(number)
        return F.when(of == "STRING", F.try_variant_get(col, "$", "string")).when(of.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"), shown)
    return None


def parse_filter(text: str | None) -> dict[str, list[str]]:
    """field:value,field:value; items without a colon are dropped, nothing is trimmed."""
    out: dict[str, list[str]] = {}
    for item in (text or "").split(","):
        name, colon, value = item.partition(":")
        if colon:
            out.setdefault(name, []).append(value)
    return out
