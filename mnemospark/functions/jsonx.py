"""JSON held in strings: tolerant reading, typed fields, builders."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

RELATION_OF = {"supports": "supports", "contradicts": "conflicts_with", "derives_from": "depends_on", "co_occurred": "occurs_with", "generalizes": "supports", "precedes": "leads_to"}


def number(c: Column, field: str) -> Column:
    """The field if it is a JSON number; null for strings that look like one."""
    return F.when(c.rlike(rf'"{field}"[ \t\n]*:[ \t\n]*-?[0-9]'), F.get_json_object(c, f"$.{field}").cast("double"))


def mapped(table: dict[str, str], key: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out


def _balanced(raw: str) -> str | None:
    """The first object or array that the decoder accepts or, failing that, the first with balanced brackets."""
    for start, c in enumerate(raw):
        if c in "{[":
            try:
                return raw[start : start + json.JSONDecoder().raw_decode(raw[start:])[1]]
            except ValueError:
                continue
    return None


@F.pandas_udf(StringType())
def tolerant_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The JSON value inside a model's answer, compact: a code fence or words around it are dropped; null if there is none."""

    def one(raw: str | None) -> str | None:
        text = (raw or "").strip()
        if text.startswith("```") and text.endswith("```") and len(text) > 6:
            text = text[3:-3]
            text = text[4:] if text[:4].lower() in ("json", "text") else text
            text = text.strip()
        for candidate in (text, _balanced(text)):
            try:
                return json.dumps(json.loads(candidate), ensure_ascii=False, separators=(",", ":"))
            except (ValueError, TypeError):
                continue
        return None

    for s in batches:
        yield s.map(one, na_action=None)


def payload_rows(c: Column, schema: str, keys: tuple[str, ...] = ("memories",)) -> Column:
    """The array of a payload that is one, or holds it under one of the keys; null if neither."""
    arrays = [F.from_json(F.when(F.startswith(F.ltrim(c), F.lit("[")), c), f"array<{schema}>")]
    arrays += [F.from_json(F.get_json_object(c, f"$.{k}"), f"array<{schema}>") for k in keys]
    return F.coalesce(*arrays)


#: Fields that hold a text, and those that lead to one, in the order in which they are asked.
TEXT_FIELDS = ("text", "content", "outputText", "inputText", "prompt", "completion", "responseText", "message", "delta")
NESTED_FIELDS = ("message", "messages", "parts", "content", "input", "output", "response", "result", "data", "choices", "delta")


def _text_of(value: object, depth: int = 0) -> str:
    if depth > 4 or value is None:
        return ""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, list):
        return "\n".join(filter(None, (_text_of(x, depth + 1) for x in value))).strip()
    if isinstance(value, dict):
        direct = next((v.strip() for v in map(value.get, TEXT_FIELDS) if isinstance(v, str) and v.strip()), "")
        return direct or next(filter(None, (_text_of(value.get(k), depth + 1) for k in NESTED_FIELDS)), "")
    return ""


@F.pandas_udf(StringType())
def nested_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The text of an event of unknown shape: the first of its text fields, down to four levels; texts of a list are joined by lines."""

    def one(raw: str | None) -> str:
        try:
            return _text_of(json.loads(raw or "null"))
        except ValueError:
            return ""

    for s in batches:
        yield s.map(one, na_action=None)


def model_text(c: Column) -> Column:
    """The text of a model's answer: the texts of its candidates' parts, or a candidate's output_text, else the answer's own text."""
    answer = F.from_json(c, "candidates array<struct<content:struct<parts:array<struct<text:string>>>,output_text:string>>, text string")
    filled = lambda xs: F.filter(xs, lambda x: F.coalesce(x != "", F.lit(False)))
    none = F.array().cast("array<string>")

    def of(candidate: Column) -> Column:
        parts = filled(F.transform(candidate["content"]["parts"], lambda p: p["text"]))
        return F.when(F.size(F.coalesce(parts, none)) > 0, parts).when(candidate["output_text"].isNotNull(), F.array(candidate["output_text"])).otherwise(none)

    texts = F.trim(F.array_join(F.flatten(F.transform(answer["candidates"], of)), "\n"))
    return F.when(F.coalesce(texts != "", F.lit(False)), texts).otherwise(F.trim(F.coalesce(answer["text"], F.lit(""))))


def conflict(metadata: Column, pair: Column, summary: Column, updated_ms: Column) -> Column:
    """The record of a conflict; what its metadata lacks or holds in another type comes from the group."""
    typed = lambda name, pattern: F.when(metadata.rlike(rf'"{name}"\s*:\s*{pattern}'), F.get_json_object(metadata, f"$.{name}"))
    status = typed("status", '"')
    return F.struct(
        F.coalesce(typed("pairKey", '"'), pair).alias("pair_key"),
        F.when(status.isin("unresolved", "dismissed", "resolved", "scoped"), status).otherwise("unresolved").alias("status"),
        typed("score", "-?[0-9]").cast("double").alias("score"),
        F.coalesce(typed("explanation", '"'), summary).alias("explanation"),
        F.coalesce(typed("detectedAt", "-?[0-9]").cast("long"), updated_ms).alias("detected_ms"),
    )


def merged_steps(old: Column, new: Column, most: int = 12) -> Column:
    """Steps (action, command) of both, of equal ones the first, numbered from 1; ``most`` at most."""
    # Lambdas evaluate again, for each element, what they name from outside: so the steps are gone through once, with what was found so far at hand.
    kind = "array<struct<order:int,action:string,command:string>>"
    start = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast(kind).alias("steps"))

    def add(found: Column, s: Column) -> Column:
        key = F.concat_ws("::", F.lower(s["action"]), F.lower(F.coalesce(s["command"], F.lit(""))))
        step = F.struct((F.size(found["steps"]) + 1).alias("order"), s["action"].alias("action"), s["command"].alias("command"))
        grown = F.struct(F.concat(found["keys"], F.array(key)).alias("keys"), F.concat(found["steps"], F.array(step)).cast(kind).alias("steps"))
        return F.when((F.size(found["steps"]) >= most) | F.array_contains(found["keys"], key), found).otherwise(grown)

    return F.aggregate(F.concat(old, new), start, add, lambda found: found["steps"])
