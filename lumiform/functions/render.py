"""Five serialisations of ordered (key, value) pairs and a body, as Column factories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The roster; its order is the order of format pairs.
FORMATS = ("yaml", "json", "toml", "inline_kv", "markdown")


def joined(pairs: Column, one: Callable[[Column], Column], separator: str) -> Column:
    return F.array_join(F.transform(pairs, one), separator)


def yaml(pairs: Column, body: Column) -> Column:
    return F.concat(F.lit("---\n"), joined(pairs, lambda p: F.concat(p["key"], F.lit(": "), p["value"]), "\n"), F.lit("\n---\n"), body)


def ascii_escaped(text: Column) -> Column:
    """A JSON string's inside: control characters and everything beyond ASCII as escapes, astral characters as surrogate pairs."""
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def one(c: Column) -> Column:
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        out = F.when(F.rlike(c, F.lit("^[ -~]$")), c).otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))
        for plain, escape in short.items():
            out = F.when(c == plain, escape).otherwise(out)
        return out

    plain = ~F.rlike(text, F.lit(r'[^ !#-\[\]-~]'))
    return F.when(plain, text).otherwise(F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), ""))


def last_wins(pairs: Column) -> Column:
    """One pair a key: at the key's first place, with its last value."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value")))


def json(pairs: Column, body: Column) -> Column:
    quoted = lambda x: F.concat(F.lit('"'), ascii_escaped(x), F.lit('"'))
    return F.concat(F.lit("{"), joined(last_wins(pairs), lambda p: F.concat(quoted(p["key"]), F.lit(": "), quoted(p["value"])), ", "), F.lit("}\n"), body)


def toml(pairs: Column, body: Column) -> Column:
    return F.concat(joined(pairs, lambda p: F.concat(p["key"], F.lit(' = "'), p["value"], F.lit('"')), "\n"), F.lit("\n"), body)


def inline_kv(pairs: Column, body: Column) -> Column:
    return F.concat(joined(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"]), " "), F.lit("\n"), body)


def markdown(pairs: Column, body: Column) -> Column:
    return F.concat(joined(pairs, lambda p: F.concat(F.lit("**"), p["key"], F.lit("**: "), p["value"]), "\n"), F.lit("\n\n"), body)


RENDERERS: dict[str, Callable[[Column, Column], Column]] = {"yaml": yaml, "json": json, "toml": toml, "inline_kv": inline_kv, "markdown": markdown}


def explode_formats(records: DataFrame, pairs: str = "pairs", body: str = "body", formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """A row for every record and format: format, fpos (its place in the roster), rendered."""
    made = F.array(*[F.struct(F.lit(n).alias("format"), F.lit(FORMATS.index(n)).alias("fpos"), RENDERERS[n](F.col(pairs), F.col(body)).alias("rendered")) for n in formats])
    return records.withColumn("r_", F.explode(made)).select("*", "r_.format", "r_.fpos", "r_.rendered").drop("r_")


def heads(pairs: str = "pairs", formats: tuple[str, ...] = FORMATS) -> Column:
    """format, fpos, head of each format: a rendering is its head, which ends a line, and the body."""
    return F.array(*[F.struct(F.lit(n).alias("format"), F.lit(FORMATS.index(n)).alias("fpos"), RENDERERS[n](F.col(pairs), F.lit("")).alias("head")) for n in formats])
