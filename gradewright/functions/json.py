"""Reading JSON that other programs wrote carelessly."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"```(?:json)?\s*\n(.*?)```", re.S | re.I)


def _valid(text: str) -> str | None:
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, (dict, list)) else None


def balanced(text: str) -> Iterator[str]:
    """Spans from an opening brace or bracket to where it closes, outside strings."""
    for m in re.finditer(r"[{\[]", text):
        depth, quoted, skip = 0, False, False
        for i in range(m.start(), len(text)):
            ch = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = ch == "\\", ch != '"'
            elif ch == '"':
                quoted = True
            elif ch in "{[":
                depth += 1
            elif ch in "}]":
                depth -= 1
                if depth == 0:
                    yield text[m.start():i + 1]
                    break


def first_json(text: str | None) -> str | None:
    """The whole text if it is a JSON object or list, else the first fenced block that is, else the first balanced span that is; null otherwise."""
    if not text:
        return None
    for part in [text, *(m.group(1) for m in _FENCE.finditer(text))]:
        if (found := _valid(part.strip())) is not None:
            return found
    return next((found for span in balanced(text) if (found := _valid(span)) is not None), None)


@F.pandas_udf(T.StringType())
def extract_json(texts: pd.Series) -> pd.Series:
    """first_json() of a column."""
    return texts.map(first_json)


# What a JSON type is called, and the Python types it reads as.
_TYPES = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}


def schema_faults(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value departs from a JSON schema's type, enum, required, properties and items; a value of a wrong type is not looked into."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, _TYPES[k]) and (k in ("boolean", "null") or not isinstance(value, bool)) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = [f"{at}: not in enum"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        out += [f"{at}: no {k}" for k in schema.get("required", ()) if k not in value]
        for k, part in schema.get("properties", {}).items():
            out += schema_faults(value[k], part, f"{at}.{k}") if k in value else []
    if isinstance(value, list) and "items" in schema:
        out += [f for i, x in enumerate(value) for f in schema_faults(x, schema["items"], f"{at}[{i}]")]
    return out


def faults_of(schema: dict):
    """A column function: schema_faults() of each JSON text; ``$: no JSON`` for what does not parse, null for null."""

    @F.pandas_udf("array<string>")
    def check(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                return schema_faults(json.loads(text), schema)
            except ValueError:
                return ["$: no JSON"]

        return texts.map(one)

    return check


def setting(text, *paths: str, default: float):
    """The number at the first of the paths that the JSON text has, else the default."""
    return F.coalesce(*[F.get_json_object(text, p).cast("double") for p in paths], F.lit(float(default)))
