"""SPDX expressions: parsed once per text, flattened to columns (Spark has no recursive type)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

_STRINGS = ArrayType(StringType())
SCHEMA = StructType([StructField("valid", BooleanType()), StructField("licences", _STRINGS), StructField("exceptions", _STRINGS), StructField("has_or", BooleanType()), StructField("permissive_option", BooleanType())])
_TOKEN = re.compile(r"\s*(\(|\)|[^\s()]+)")
_COPYLEFT = re.compile(r"^(GPL|AGPL|LGPL|MPL|EPL|EUPL|CDDL|CPL|OSL|SSPL|CECILL)", re.I)


class _Parser:
    """OR binds weaker than AND, AND weaker than WITH."""

    def __init__(self, text: str):
        self.tokens = [m[1] for m in _TOKEN.finditer(text)]
        self.at, self.licences, self.exceptions, self.has_or = 0, [], [], False

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        token = self.peek()
        if token is None:
            raise ValueError("the expression ends early")
        self.at += 1
        return token

    def either(self) -> bool:
        out = self.both()
        while (self.peek() or "").upper() == "OR":
            self.take()
            self.has_or = True
            out = self.both() or out
        return out

    def both(self) -> bool:
        out = self.single()
        while (self.peek() or "").upper() == "AND":
            self.take()
            out = self.single() and out
        return out

    def single(self) -> bool:
        token = self.take()
        if token == "(":
            out = self.either()
            if self.take() != ")":
                raise ValueError("a parenthesis is open")
            return out
        if token == ")" or token.upper() in ("AND", "OR", "WITH"):
            raise ValueError(f"{token} is out of place")
        self.licences.append(token)
        free = not _COPYLEFT.match(token)
        if (self.peek() or "").upper() == "WITH":
            self.take()
            self.exceptions.append(self.take())
            free = True
        return free


def parse(text: str | None) -> tuple:
    """(valid, licences, exceptions, has_or, permissive_option)."""
    if not (text or "").strip():
        return (False, [], [], False, False)
    p = _Parser(text)
    try:
        free = p.either()
    except ValueError:
        return (False, [], [], False, False)
    if p.peek() is not None:
        return (False, [], [], False, False)
    return (True, p.licences, p.exceptions, p.has_or, free)


@pandas_udf(SCHEMA)
def spdx(expression: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(x) for x in expression], columns=["valid", "licences", "exceptions", "has_or", "permissive_option"])
