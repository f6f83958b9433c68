"""Row-local decisions about texts: threats, noise, what to capture and what to recall."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mnemospark.functions import text as T
from mnemospark.functions.jsonx import number
from mnemospark.operators.common import checkpoint
from mnemospark.sources.tables import DAY_MS

# These patterns and phrases decide what is kept, so they must be these.
S = r"[ \t\n\r\f]"
THREATS = (
    ("invisible_unicode", r"[\u200B\u200C\u200D\u2060\uFEFF\u202A\u202B\u202C\u202D\u202E]"),
    ("prompt_injection", rf"(?im)ignore{S}+(all{S}+)?previous{S}+instructions|disregard{S}+(all{S}+)?(your{S}+)?rules|system{S}+prompt{S}+override|(?:^|from{S}+now{S}+on[,:]?{S}+)you{S}+are{S}+now{S}+(?:a|an|in)\b|act{S}+as{S}+if{S}+you{S}+have{S}+no{S}+restrictions"),
    ("exfiltration", rf"(?i)(?:curl|wget){S}+.*\$\{{?[A-Za-z0-9_]*(?:SECRET|KEY|TOKEN|PASSWORD|CREDENTIAL)[A-Za-z0-9_]*\}}?|cat{S}+(?:/[A-Za-z0-9_./]*)?\.env\b.*\|{S}*(?:curl|wget|nc|sendmail)|cat{S}+(?:/[A-Za-z0-9_./]*)?\.env\b.*(?:send|post|upload)\b|cat{S}+(?:/[A-Za-z0-9_./]*)?credentials(?:\.json|\.yaml|\.yml|\.toml)?\b"),
    ("role_hijacking", rf"(?im)(?:^|you{S}+(?:must|should|will){S}+)do{S}+not{S}+tell{S}+the{S}+user|(?:i{S}+want{S}+you{S}+to|you{S}+(?:must|should|will)){S}+pretend{S}+to{S}+be\b|override{S}+your{S}+personality"),
    ("encoded_payload", "[A-Za-z0-9+/=]{500}"),
)
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u202a\u202b\u202c\u202d\u202e"
ACKNOWLEDGED = rf"(?i)^(NO_REPLY|ok|sure|got it|okay|yep|yeah|nope|nah|thanks|thank you)[!., \t\n\r\f]*$"
GREETED = r"(?i)^(hi|hello|hey|good morning|good afternoon|good evening)[!., \t\n\r\f]*$"
REFUSED = "(?i)^(I don't have|I cannot|I'm not able to)"
ASKS_MEMORY = r"(?i)\b(remember|recall|previously|last time|earlier|before|memory|forgot|what did we|when did we|history)\b"
ASKS_EVIDENCE = r"(?i)\b(what did we|when did we|last time|earlier|previously|before|history|remember|recall|forgot|verbatim|exact wording|exactly what)\b"
NAMES_PERSON = r"(?is)\b(?:my|our|their)\b.{0,80}\b(name|names|birthday|birthdays|dob|date of birth)\b"
NAMES_DAY = rf"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?{S}+[0-9]{{1,2}}\b"
ISO_DAY = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
GENERIC = (
    "what can you do", "how do i use", "how do you work", "what are you", "help me", "who are you", "what is this", "how does this work",
    "tell me about yourself", "what do you know", "can you help", "what are your capabilities", "how can you help", "what should i do", "get started",
)
PROGRESS = r"(?i)^(Working:|Planning next steps\.|awaiting approval\b|approval unavailable\b)"
AMOUNTS = rf"\$[ \t]*[0-9]+(?:[.,][0-9]+)?[ \t]*[kmb]?\b|\b[0-9]+(?:[.,][0-9]+)?%?"
DATES = r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?[ \t]+[0-9]{1,2}\b|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b"
#: The columns of fact_ids().
FACTS = ("amounts", "dates", "negated")
NEGATED = r"\b(no|not|never|isn't|aren't|wasn't|won't|can't|cannot|false|disabled|blocked)\b"


@F.pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility form of a text; Spark has no such function."""
    for s in batches:
        yield s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def _any(c: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


def threat(c: Column) -> Column:
    """The first threat of a text, or null.  Expects compatibility form: nfkc() for texts that aren't ASCII.

    Patterns are tried on texts that have the letters without which they can't match: few have, and these are found much faster.
    """
    may = {
        "prompt_injection": lambda t: _any(t, "instructions", "rules", "override", "restrictions") | (F.contains(t, F.lit("you")) & F.contains(t, F.lit("now"))),
        "exfiltration": lambda t: (F.contains(t, F.lit("$")) & _any(t, "curl", "wget")) | (F.contains(t, F.lit("cat")) & _any(t, ".env", "credentials")),
        "role_hijacking": lambda t: _any(t, "tell", "pretend", "personality"),
    }
    names = dict(THREATS)

    def first(x: Column) -> Column:
        text, low = x["text"], x["low"]
        out = F.when(_beyond_ascii(text) & _any(text, *INVISIBLE), F.lit("invisible_unicode"))
        for name, able in may.items():
            out = out.when(able(low) & text.rlike(T.ascii_edges(names[name])), F.lit(name))
        # A run of 500 letters has its first 500 where it begins: other places needn't be tried.
        return out.when((F.length(text) >= 500) & text.rlike(rf"(?<![A-Za-z0-9+/=]){names['encoded_payload']}"), F.lit("encoded_payload"))

    # In a lambda's argument, text and lower case are made once.
    return F.transform(F.array(F.struct(c.alias("text"), F.lower(c).alias("low"))), first)[0]


def _beyond_ascii(c: Column) -> Column:
    return F.octet_length(c) != F.length(c)


def scanned(c: Column) -> Column:
    """threat() of the compatibility form; only texts beyond ASCII pay for a Python worker's work on them."""
    return threat(F.when(_beyond_ascii(c), nfkc(F.when(_beyond_ascii(c), c))).otherwise(c))


def noise(content: Column, title: Column, app: str = "Agent") -> Column:
    """The kind of noise that a captured row is, or null."""
    t = T.trim(content)
    said = T.trim(F.regexp_replace(t, rf"(?i)^Assistant:{S}*", ""))
    return (
        F.when(said == "HEARTBEAT_OK", "heartbeat_ok")
        .when(said.rlike(T.ascii_edges(r"\bHEARTBEAT_OK\b")) & (F.length(said) < 200), "unchanged_heartbeat")
        .when(said.rlike(T.ascii_edges(r"\bNO_REPLY") + S + "*$") & ((F.length(said) < 200) | (said == "NO_REPLY")), "no_reply")
        .when((F.length(said) < 30) & F.startswith(title, F.lit(app)), "short_system")
        .when(t.rlike(rf"^(Assistant:{S}*)?System:{S}*\[") & (F.length(t) < 200), "system_exec")
    )


def noise_aggressive(content: Column, title: Column, tags: Column, app: str = "Agent") -> Column:
    n = F.length(T.trim(content))
    log = title.rlike(rf"^{app}{S}[—–-]{S}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{S}[0-9]{{2}}:[0-9]{{2}}")
    return F.coalesce(noise(content, title, app), F.when(F.array_contains(tags, "auto-capture") & (n < 100), "short_auto_capture").when(log & (n < 50), "short_log"))


def worth_capturing(user: Column, assistant: Column) -> Column:
    """No heartbeats, acknowledgements, greetings, short refusals or answers under 20 letters."""
    t = T.trim(assistant)
    dull = T.trim(user).rlike("(?i)HEARTBEAT") | (F.length(t) < 20) | t.rlike("(?i)^HEARTBEAT_OK$") | t.rlike(ACKNOWLEDGED) | t.rlike(GREETED) | ((F.length(t) < 100) & t.rlike(REFUSED))
    return ~dull


def worth_recalling(query: Column) -> Column:
    """Whether a prompt deserves a memory lookup; words that ask for memory always do."""
    q = T.trim(query)
    greeted = q.rlike(r"(?i)^(hi|hello|hey|good morning|good afternoon|good evening|howdy)[!., \t\n\r\f]*$")
    answered = q.rlike(r"(?i)^(yes|no|ok|sure|thanks|thank you|nope|yep|yeah|nah)[!., \t\n\r\f]*$")
    dull = (F.length(q) < 4) | F.startswith(q, F.lit("/")) | greeted | answered | ~q.rlike("[a-zA-Z]") | q.rlike("(?i)HEARTBEAT")
    return q.rlike(T.ascii_edges(ASKS_MEMORY)) | ~dull


def wants_evidence(prompt: Column) -> Column:
    p = T.trim(prompt)
    return p.rlike(T.ascii_edges(ASKS_EVIDENCE)) | p.rlike(T.ascii_edges(NAMES_PERSON)) | p.rlike(T.ascii_edges(NAMES_DAY)) | p.rlike(T.ascii_edges(ISO_DAY))


def good_trace(query: Column, least_words: int = 5) -> Column:
    q = T.folded(query)
    generic = F.lit(False)
    for phrase in GENERIC:
        generic = generic | F.contains(q, F.lit(phrase))
    return (F.size(T.words(query)) >= least_words) & ~generic


def skips_search(query: Column) -> Column:
    """Too short, or mostly indented lines as in code."""
    lines = F.filter(F.split(query, "\n"), lambda x: T.trim(x) != "")
    indented = F.size(F.filter(lines, lambda x: x.rlike("^[\t ]")))
    return (F.length(T.trim(query)) < 10) | (F.size(lines) == 0) | (indented > F.size(lines) * 0.5)


def progress_notice(c: Column, most: int = 80) -> Column:
    t = T.trim(c)
    return (t == "") | (t.rlike(T.ascii_edges(PROGRESS)) & (F.length(t) <= most))


def stale_workflow(store: Column, category: Column, metadata: Column, now_ms: int, least: int = 3, days: int = 30) -> Column:
    """Workflows seen too rarely and not of late; false where the numbers are missing."""
    seen, last = number(metadata, "observationCount"), number(metadata, "lastObserved")
    return F.coalesce((store == "procedural") & (category == "workflow") & (seen < least) & (now_ms - last >= days * DAY_MS), F.lit(False))


def facts_differ(a: Column, b: Column) -> Column:
    """Different amounts or dates where both have some, or only one is negated."""

    def differ(pattern):
        x, y = (F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(T.ascii_edges(pattern)), F.lit(0))) for t in (a, b))
        return (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) > 0) | (F.size(F.array_except(y, x)) > 0))

    return differ(AMOUNTS) | differ(DATES) | (F.lower(a).rlike(T.ascii_edges(NEGATED)) != F.lower(b).rlike(T.ascii_edges(NEGATED)))


def fact_ids(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, amounts, dates, negated) of each row's text, as numbers: texts of the same amounts (or dates) have the least id of a row that has them, null without any.  Whether facts_differ() of two texts is then told from six numbers."""
    low = F.col("low")
    # Most texts have nothing of the kind, which is seen faster without edges of words.
    found = lambda p, may: F.when(low.rlike(may), F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(T.ascii_edges(p)), F.lit(0)))))
    day = r"[0-9][-/][0-9]|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?[ \t]+[0-9]"
    f = rows.select(id_col, F.lower(text).alias("low")).select(id_col, found(AMOUNTS, "[0-9]").alias("amounts"), found(DATES, day).alias("dates"), low.rlike(T.ascii_edges(NEGATED)).cast("long").alias("negated"))
    f = f.select(id_col, *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("amounts", "dates")], "negated")
    f = checkpoint(f)  # texts are searched once, not once more for each kind
    for c in ("amounts", "dates"):
        names = f.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(id_col).alias(f"{c}_id"))
        f = f.join(names, c, "left").drop(c).withColumnRenamed(f"{c}_id", c)
    return f.select(id_col, *FACTS)


def ids_differ(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """facts_differ() of pairs from their fact_ids(), where -1 stands for null."""
    out = np.zeros(1, bool)
    for c in FACTS:
        out = out | ((a[c] >= 0) & (b[c] >= 0) & (a[c] != b[c]))
    return out
