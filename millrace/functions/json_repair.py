"""JSON objects in model responses, with LaTeX that was not escaped."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reads what strict parsing cannot, or raises; any tolerant parser will do.
Repair = Callable[[str], object]

#: LaTeX commands whose single backslash is meant as text.
LATEX_COMMANDS = [
    "frac", "dfrac", "tfrac", "sqrt", "boxed", "begin", "end", "left", "right", "cdot", "times", "div", "pm", "mp", "le", "leq", "ge", "geq", "neq", "approx", "equiv",
    "ldots", "cdots", "dots", "text", "mathrm", "mathbf", "mathbb", "operatorname", "binom", "sum", "prod", "int", "lim", "log", "ln", "sin", "cos", "tan", "theta",
    "alpha", "beta", "gamma", "delta", "pi", "infty", "overline", "underline", "vec",
]
#: A single backslash before one of them as a whole word, or before a bracket.
_BEFORE_COMMAND = re.compile(r"(?<!\\)\\(?=(?:" + "|".join(LATEX_COMMANDS) + r")\b|[()\[\]])")
#: Fixed value: a backslash that begins no JSON escape.
_NO_ESCAPE = re.compile(r'\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})')

#: An object that needs no repair: its members are strings without backslashes, whole numbers, true, false and null.
_MEMBER = r'"[^"\\\x00-\x1f]*+"\s*+:\s*+(?:"[^"\\\x00-\x1f]*+"|true|false|null|-?[1-9][0-9]{0,14}+|0)\s*+'
_FLAT = r"(?s)\A\s*+\{\s*+" + f"(?:{_MEMBER},\\s*+)*+{_MEMBER}" + r"\}\s*+\z"


def extract_json_object(text: str, repair: Repair | None = None) -> dict:
    """The object in a response; ValueError if there is none.

    A code fence is opened, the text from the first ``{`` to the last ``}`` is taken, and backslashes of
    known LaTeX commands are doubled. Should that not parse, those of every invalid escape are doubled too;
    should that not parse either, ``repair`` is asked if given.
    """
    body = text.strip()
    if body.startswith("```"):
        body = body[3:].removeprefix("json").lstrip()
        body = body.removesuffix("```").rstrip()
    first, last = body.find("{"), body.rfind("}")
    if not 0 <= first < last:
        try:
            json.loads(body)
        except json.JSONDecodeError:
            raise ValueError("the response holds no JSON object") from None
        raise ValueError("the response's JSON is not an object")
    body = _BEFORE_COMMAND.sub(r"\\\\", body[first : last + 1])
    steps: list[Repair] = [json.loads, lambda t: json.loads(_NO_ESCAPE.sub(r"\\\\", t)), *([repair] if repair else [])]
    for step in steps:
        try:
            value = step(body)
        except Exception:  # a tolerant parser may raise anything
            continue
        if isinstance(value, dict):
            return value
        raise ValueError("the response's JSON is not an object")
    raise ValueError("the response's JSON cannot be repaired")


def json_fields(response: Column, fields: list[str], repair: Repair | None = None) -> Column:
    """``ok``, ``error`` and the fields as strings (null where absent).

    A response that is one flat JSON object of whole numbers, words and strings without backslashes needs no
    repair and is read by the engine; the rest goes to Python in Arrow batches.
    """
    ddl = "ok boolean, error string, " + ", ".join(f"`{f}` string" for f in fields)

    @F.pandas_udf(ddl)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                if t is None:  # read by the engine
                    rows.append([False, "the response holds no JSON object", *[None] * len(fields)])
                    continue
                try:
                    value = extract_json_object(t, repair)
                    rows.append([True, None, *(None if value.get(f) is None else v if isinstance(v := value[f], str) else json.dumps(v, ensure_ascii=False) for f in fields)])
                except ValueError as e:
                    rows.append([False, str(e), *[None] * len(fields)])
            yield pd.DataFrame(rows, columns=["ok", "error", *fields])

    keys = F.when(response.rlike(_FLAT), F.json_object_keys(response))
    easy = F.coalesce(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(False))
    direct = F.struct(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), *(F.get_json_object(response, f"$['{f}']").alias(f) for f in fields))
    return F.when(easy, direct).otherwise(read(F.when(~easy, response)))
