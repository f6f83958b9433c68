"""Structure inside texts, where brackets must be matched: Arrow batches through small parsers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType

CONTEXT = "recalled_context"
#: Tag names and the kind of section that each opens.
SECTIONS = {"recalled_context": "recalled", "user": "user", "user_message": "user", "assistant": "assistant", "system": "system"}
_TAG = re.compile(r"</?(" + "|".join(SECTIONS) + r")(?:\s[^<>]*)?>", re.I)


def _without_context(text: str | None) -> tuple[str, bool, int]:
    """(rest, malformed, letters dropped)."""
    text, dropped = text or "", 0
    while True:
        m = re.match(rf"\s*<{CONTEXT}>", text)
        if not m:
            return text, False, dropped
        depth, end = 0, None
        for t in re.finditer(rf"<(/?){CONTEXT}>", text):
            depth += -1 if t[1] else 1
            if depth == 0:
                end = t.end()
                break
        if end is None:
            return "", True, dropped
        dropped += end
        text = text[end:].lstrip()


@F.pandas_udf(StructType().add("content", StringType()).add("malformed", BooleanType()).add("dropped", LongType()))
def without_context(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """What follows the balanced leading blocks of recalled context; empty and malformed if one doesn't end."""
    for s in batches:
        yield pd.DataFrame([_without_context(t) for t in s], columns=["content", "malformed", "dropped"])


def stripped(c: Column) -> Column:
    """without_context(), with texts that have no such block left alone in the JVM."""
    has = c.rlike(rf"^\s*<{CONTEXT}>")
    return F.when(has, without_context(F.when(has, c))).otherwise(F.struct(c.alias("content"), F.lit(False).alias("malformed"), F.lit(0).cast("long").alias("dropped")))


def split_sections(text: str | None) -> list[dict]:
    out: list[dict] = []
    open_tags: list[str] = []

    def add(raw: str) -> None:
        body = " ".join(raw.split())
        kind = open_tags[-1] if open_tags else "body"
        if body and out and out[-1]["kind"] == kind:
            out[-1]["text"] += "\n\n" + body
        elif body:
            out.append({"kind": kind, "text": body})

    at = 0
    for m in _TAG.finditer(text or ""):
        add(text[at : m.start()])
        kind = SECTIONS[m[1].lower()]
        if m[0][1] != "/":
            open_tags.append(kind)
        elif kind in open_tags:
            del open_tags[len(open_tags) - 1 - open_tags[::-1].index(kind) :]
        at = m.end()
    add((text or "")[at:])
    return out


@F.pandas_udf(ArrayType(StructType().add("kind", StringType()).add("text", StringType())))
def sections(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The sections of a text by tag, neighbours of one kind joined."""
    for s in batches:
        yield s.map(split_sections, na_action=None)


def _section_body(text: str, headings: str) -> str:
    """What stands under the first ``## heading`` with one of these names, up to the next ``##``."""
    lines, found = [], False
    for line in text.split("\n"):
        if found and re.match(r"##\s+", line):
            break
        if found:
            lines.append(line)
        found = found or bool(re.match(rf"##\s+(?:{headings})\s*$", line, re.I))
    return "\n".join(lines).strip()


def _skill(text: str | None) -> dict:
    text = text or ""
    bullet = lambda x: re.sub(r"^[-*+]\s+", "", x.strip()).strip()
    lines = [x.strip() for x in (_section_body(text, "Steps|Procedure|Workflow") or text).split("\n")]
    steps = [re.sub(r"^\d+\.\s+", "", bullet(x)) for x in lines if re.match(r"(\d+\.|[-*+])\s+", x)]
    checks = [bullet(re.sub(r"^\d+\.\s+", "", x.strip())) for x in _section_body(text, "Verification|Success Criteria").split("\n")]
    when = [bullet(x) for x in _section_body(text, "Trigger Conditions|When to Use|Activation").split("\n")]
    command = lambda s: (m[1] if (m := re.search("`([^`]+)`", s)) else None)
    return {
        "triggers": list(dict.fromkeys(x for x in when if x)),
        "steps": [{"action": s.replace("`", "").strip(), "command": command(s)} for s in steps if s],
        "verification": next((x for x in checks if x), "Confirm the expected outcome is visible before concluding the task."),
    }


@F.pandas_udf(StructType().add("triggers", ArrayType(StringType())).add("steps", ArrayType(StructType().add("action", StringType()).add("command", StringType()))).add("verification", StringType()))
def skill_parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Triggers, ordered steps and the verification of a skill document."""
    for s in batches:
        yield pd.DataFrame([_skill(t) for t in s], columns=["triggers", "steps", "verification"])
