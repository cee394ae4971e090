"""Encryption of values at paths of nested records.

A path names fields from a top column down, with ``[*]`` for every element of a list: ``owners[*].ssn``. Paths
become column expressions when the plan is made: transform over lists, withField in structs; rows stay where
they are. Each value is replaced by a mark, its ciphertext (AES-GCM, an IV of its own) kept in a map keyed by
the *concrete* path, ``owners[1].ssn``, so that every element of a list comes back.

Defined cases: nulls, at any level, stay null and get no ciphertext. A path that the schema lacks changes
nothing. A value that is marked and has its ciphertext stays as it is, so a second run changes nothing; one that
only looks like the mark is encrypted like any other. Values that are no strings become strings; ``types`` of
``decrypt_paths`` gives them their type back. With a wrong key the marks and their ciphertexts stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

MARK, ENVELOPE = "[ENCRYPTED]", "envelope"
NO_MAP, NO_ENTRIES = "cast(map() as map<string,string>)", "cast(array() as array<struct<k:string,v:string>>)"


def parts_of(path: str) -> list[str]:
    return path.replace("[*]", ".[*]").split(".")


def concrete(paths: list[str]) -> str:
    """A pattern of the concrete paths that the paths stand for."""
    return "^(?:" + "|".join(re.escape(p).replace(r"\[\*\]", r"\[\d+\]") for p in paths) + ")$"


def known(schema: StructType, parts: list[str]) -> bool:
    """Whether the schema has a value (no struct, list or map) at the path."""
    kind: DataType = schema
    for p in parts:
        if p == "[*]" and isinstance(kind, ArrayType):
            kind = kind.elementType
        elif p != "[*]" and isinstance(kind, StructType) and p in kind.names:
            kind = kind[p].dataType
        else:
            return False
    return not isinstance(kind, StructType | ArrayType | MapType)


def rewritten(c: Column, parts: list[str], at: Column, leaf: Callable[[Column, Column], Column]) -> Column:
    """``c`` with ``leaf(value, concrete path)`` at the end of the path."""
    if not parts:
        return leaf(c, at)
    if parts[0] == "[*]":
        return F.transform(c, lambda x, i: rewritten(x, parts[1:], F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), leaf))
    return c.withField(f"`{parts[0]}`", rewritten(c[parts[0]], parts[1:], F.concat(at, F.lit(f".{parts[0]}")), leaf))


def gathered(c: Column, parts: list[str], at: Column, entries: Callable[[Column, Column], Column]) -> Column:
    """What ``entries(value, concrete path)`` gives for every value at the path, as one list."""
    if not parts:
        return entries(c, at)
    if parts[0] == "[*]":
        each = F.transform(c, lambda x, i: gathered(x, parts[1:], F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), entries))
        return F.coalesce(F.flatten(each), F.expr(NO_ENTRIES))
    return gathered(c[parts[0]], parts[1:], F.concat(at, F.lit(f".{parts[0]}")), entries)


def _everywhere(df: DataFrame, paths: list[str], leaf_of: Callable[[str], Callable[[Column, Column], Column]]) -> dict[str, Column]:
    """The new top columns."""
    out: dict[str, Column] = {}
    for path in paths:
        head, *rest = parts_of(path)
        out[head] = rewritten(out.get(head, F.col(f"`{head}`")), rest, F.lit(head), leaf_of(path))
    return out


def _in_schema(df: DataFrame, paths: list[str]) -> list[str]:
    return [p for p in dict.fromkeys(paths) if known(df.schema, parts_of(p))]


def encrypt_paths(df: DataFrame, paths: list[str], key: Column, envelope: str = ENVELOPE) -> DataFrame:
    """``df`` with the values at ``paths`` marked and their ciphertexts in the map ``envelope``; entries of other
    paths are kept."""
    paths = _in_schema(df, paths)
    old = F.coalesce(F.col(envelope), F.expr(NO_MAP)) if envelope in df.columns else F.expr(NO_MAP)

    def entry(value: Column, at: Column) -> Column:
        done = (value.cast("string") == MARK) & F.map_contains_key(old, at)
        cipher = F.when(done, F.try_element_at(old, at)).otherwise(F.base64(F.aes_encrypt(value.cast("string").cast("binary"), key)))
        return F.when(value.isNotNull(), F.array(F.struct(at.alias("k"), cipher.alias("v")))).otherwise(F.expr(NO_ENTRIES))

    lists = []
    for path in paths:
        head, *rest = parts_of(path)
        lists.append(gathered(F.col(f"`{head}`"), rest, F.lit(head), entry))
    if not paths:
        return df.withColumn(envelope, old)
    others = F.map_filter(old, lambda k, v: ~k.rlike(concrete(paths)))
    sealed = F.map_concat(others, F.map_from_entries(F.concat(*lists)))
    marked = _everywhere(df, paths, lambda _: lambda value, at: F.when(value.isNotNull(), F.lit(MARK)))
    return df.withColumns({envelope: sealed} | marked)


def decrypt_paths(df: DataFrame, paths: list[str], key: Column, types: dict[str, str] | None = None, envelope: str = ENVELOPE) -> DataFrame:
    """The inverse of ``encrypt_paths``: values that decrypt are set and leave the envelope."""
    paths, types = _in_schema(df, paths), types or {}
    if not paths:
        return df
    plain = lambda cipher: F.try_aes_decrypt(F.unbase64(cipher), key).cast("string")

    def opened(path: str):
        def leaf(value: Column, at: Column) -> Column:
            marked = F.when(value.cast("string") == MARK, plain(F.try_element_at(envelope, at)))
            return F.coalesce(marked, value.cast("string")).cast(types.get(path, "string"))

        return leaf

    rest = F.map_filter(envelope, lambda k, v: ~(k.rlike(concrete(paths)) & plain(v).isNotNull()))
    return df.withColumns(_everywhere(df, paths, opened) | {envelope: rest})
