"""Names and canonical forms: what Spark's own functions cannot say. Arrow-batched UDFs."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.schemas import SAFE_INTEGER

MOST_DEPTH = 64


def comparison_key(name: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", name).casefold())


def path_key(path: str) -> str:
    return "/".join(map(comparison_key, path.split("/")))


def canonical_line(record: dict) -> str:
    """Sorted keys, no spaces, ASCII only."""
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def _checked(value: object, depth: int = 0) -> None:
    if depth > MOST_DEPTH:
        raise ValueError("too deep")
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return
    if isinstance(value, int):
        if abs(value) > SAFE_INTEGER:
            raise ValueError("integer out of range")
    elif isinstance(value, list):
        for v in value:
            _checked(v, depth + 1)
    elif isinstance(value, dict):
        for v in value.values():
            _checked(v, depth + 1)
    else:
        raise ValueError(f"{type(value).__name__} has no canonical form")


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate key")
    return out


#: A backslash and what follows it; the short escapes of control characters are written in full in the canonical form.
_SHORT = re.compile(r"\\(.)")
_LONG = {c: f"\\u{ord(x):04x}" for c, x in (("b", "\b"), ("t", "\t"), ("n", "\n"), ("f", "\f"), ("r", "\r"))}


def canonical_bytes(text: str) -> bytes:
    """A JSON text's canonical bytes: UTF-8, sorted keys, integers within 2**53, a line feed last."""
    value = json.loads(text, object_pairs_hook=_unique)
    _checked(value)
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return (_SHORT.sub(lambda m: _LONG.get(m[1], m[0]), text) + "\n").encode()


def strings_in(text: str, scalars: bool = False) -> list[str]:
    """Every key and string of a JSON text, in order; numbers and truth values too if asked for."""
    out: list[str] = []

    def visit(value: object) -> None:
        if isinstance(value, str):
            out.append(value)
        elif isinstance(value, list):
            for v in value:
                visit(v)
        elif isinstance(value, dict):
            for k, v in value.items():
                out.append(k)
                visit(v)
        elif scalars and value is not None:
            out.append(json.dumps(value))

    visit(json.loads(text))
    return out


def _or_null(f):
    def run(x):
        if x is None:
            return None
        try:
            return f(x)
        except (ValueError, RecursionError):
            return None

    return run


@F.pandas_udf(T.StringType())
def comparison_key_udf(names: pd.Series) -> pd.Series:
    return names.map(comparison_key, na_action="ignore")


@F.pandas_udf(T.StringType())
def normal_form_udf(names: pd.Series) -> pd.Series:
    return names.map(lambda name: unicodedata.normalize("NFC", name), na_action="ignore")


@F.pandas_udf(T.StringType())
def path_key_udf(paths: pd.Series) -> pd.Series:
    return paths.map(path_key, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def canonical_bytes_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_or_null(canonical_bytes))


@F.pandas_udf(T.StringType())
def canonical_line_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_or_null(lambda t: canonical_line(json.loads(t, object_pairs_hook=_unique))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def strings_in_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_or_null(strings_in))
