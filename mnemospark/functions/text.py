"""Text as Column expressions.  White space is ASCII; lengths are code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f]"
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    """The pattern with word boundaries between ASCII letters, digits and _ and all else, as they are outside of Java."""
    return pattern.replace(r"\b", _EDGE)


def trim(c: Column) -> Column:
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\f"))


def folded(c: Column) -> Column:
    """Trimmed and in lower case; null is empty."""
    return F.lower(trim(c))


def collapsed(c: Column) -> Column:
    """Folded, with every run of white space as one blank."""
    return F.regexp_replace(folded(c), SPACE + "+", " ")


def one_line(c: Column) -> Column:
    return trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE + "+", " "))


def words_up_to(c: Column, most: int) -> Column:
    """The number of words of a text, or ``most`` + 1 if it has more: what comes after them isn't split."""
    t = trim(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, SPACE + "+", most + 1)))


def words(c: Column) -> Column:
    """The words of a text between white space."""
    return F.filter(F.split(trim(c), SPACE + "+"), lambda w: w != "")


def tokens(c: Column, least: int = 2) -> Column:
    """Runs of a-z and 0-9 of the folded text, of ``least`` letters or more."""
    return F.filter(F.split(folded(c), "[^a-z0-9]+"), lambda t: F.length(t) >= least)


def query_tokens(query: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", query.strip().lower()) if len(t) >= 2]


def text_match(query: str, title: Column, content: Column, tags: Column | None = None) -> Column:
    """1 if the whole query occurs, else the share of its tokens that do; repeated tokens count once above and each time below."""
    phrase = re.sub(r"\s+", " ", query.strip().lower())
    if not phrase:
        return F.lit(0.0)
    hay = collapsed(F.concat_ws(" ", title, content, *([F.concat_ws(" ", tags)] if tags is not None else [])))
    found = query_tokens(query)
    exact = F.contains(hay, F.lit(phrase)).cast("double")
    if not found:
        return exact
    distinct = sorted(set(found))
    hits = sum(F.contains(hay, F.lit(t)).cast("double") for t in distinct)
    return F.least(F.lit(1.0), F.greatest(exact, hits / len(found)))


def unquoted(value: str) -> str:
    """A query without the pair of quotes around it."""
    value = value.strip()
    if len(value) > 2 and value[0] in "\"'`" and value[-1] == value[0] and value[1:-1].strip():
        return value[1:-1].strip()
    return value


def without_quotes(c: Column) -> Column:
    t = trim(c)
    inner = trim(F.substring(t, F.lit(2), F.length(t) - 2))
    paired = (F.length(t) > 2) & F.substring(t, 1, 1).isin('"', "'", "`") & (F.substring(t, 1, 1) == F.substring(t, -1, 1)) & (inner != "")
    return F.when(paired, inner).otherwise(t)


def lexical_score(query: str, content: Column) -> Column:
    """5 for the phrase, 1 more for it at the start, and the share of the words found; 0 if nothing is."""
    phrase = unquoted(query).lower()
    hay = F.lower(content)
    parts = [w for w in phrase.split() if len(w) >= 2]
    exact = F.when(F.contains(hay, F.lit(phrase)), 5.0).otherwise(0.0) if len(phrase) >= 2 else F.lit(0.0)
    starts = F.when(F.startswith(hay, F.lit(phrase)), 1.0).otherwise(0.0) if len(phrase) >= 2 else F.lit(0.0)
    hits = sum((F.contains(hay, F.lit(w)).cast("double") for w in parts), F.lit(0.0))
    return F.coalesce(F.when((exact == 0) & (hits == 0), 0.0).otherwise(exact + starts + hits / max(1, len(parts))), F.lit(0.0))


def hash_text(c: Column) -> Column:
    """The form under which texts count as equal: line ends, blanks and empty lines are evened out."""
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    c = F.when(F.contains(c, F.lit("\n")), F.regexp_replace(c, "[ \t]*\n[ \t]*", "\n")).otherwise(c)
    c = F.regexp_replace(c, "[ \t]{2,}|\t", " ")
    return trim(F.when(F.contains(c, F.lit("\n\n\n")), F.regexp_replace(c, "\n{3,}", "\n\n")).otherwise(c))


def token_pattern(token: str) -> str:
    """Where a token (of a-z and 0-9) stands in lower-case text as a whole run."""
    return f"(?<![a-z0-9]){re.escape(token)}(?![a-z0-9])"


def message_hash(role: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\n", role, F.lower(hash_text(content))), 256)


def memory_hash(store: Column, category: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\n", store, category, F.lower(hash_text(content))), 256)


def turn_scope(turn_id: Column, session: Column, turn_index: Column) -> Column:
    """What a repeated message must share besides its text to be a repeat."""
    by_turn = F.concat_ws(":", F.lit("turn"), turn_id, F.coalesce(turn_index, F.lit(-1)).cast("string"))
    by_session = F.concat_ws(":", F.lit("session-turn"), turn_index.cast("string"))
    return F.when(turn_id.isNotNull(), by_turn).when(session.isNotNull() & turn_index.isNotNull(), by_session).otherwise("near-time")


def dedupe_scope(user: Column, role: Column, content_hash: Column, channel: Column, session: Column, turn_id: Column, turn_index: Column) -> Column:
    empty = F.lit("")
    parts = [user.cast("string"), role, content_hash, F.coalesce(channel, empty), F.coalesce(session.cast("string"), empty), turn_scope(turn_id, session, turn_index)]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def slug(c: Column, prefix: Column | None = None) -> Column:
    """a-z, 0-9 and single dashes; ``untitled`` where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(folded(c), "[^a-z0-9]+", "-"), "^-|-$", "")
    s = F.when(s == "", "untitled").otherwise(s)
    return s if prefix is None else F.concat(prefix, F.lit(":"), s)


def dedupe_key(title: Column, content: Column) -> Column:
    return F.concat_ws("::", collapsed(title), collapsed(content))


def _bound(c: Column, f) -> Column:
    """f of the value of c, which is computed once: inside lambdas an expression of a row would be computed for each element."""
    return F.element_at(F.transform(F.array(c), f), 1)


def bigrams(c: Column) -> Column:
    """The distinct pairs of neighbouring tokens; the tokens themselves if there are fewer than two."""

    def pairs(t):
        n = F.size(t) - 1
        return F.array_distinct(F.when(n < 1, t).otherwise(F.zip_with(F.slice(t, F.lit(1), F.greatest(n, F.lit(0))), F.slice(t, F.lit(2), F.greatest(n, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))))

    return _bound(tokens(c, 1), pairs)


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two arrays of distinct values; ``empty`` if both are."""

    def of(x):
        both = F.size(F.array_union(x["a"], x["b"]))
        return F.when(both == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(x["a"], x["b"])) / both)

    return _bound(F.struct(a.alias("a"), b.alias("b")), of)


def significant_words(c: Column) -> Column:
    return F.filter(words(F.lower(c)), lambda w: F.length(w) > 3)


def overlap_share(a: Column, b: Column) -> Column:
    """Share of the words of a, repeats included, that b has, of the longer one."""

    def share(x):
        hits = F.size(F.filter(x["a"], lambda w: F.array_contains(x["b"], w)))
        return F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), 0.0).otherwise(hits / F.greatest(F.size(x["a"]), F.size(x["b"])))

    return _bound(F.struct(a.alias("a"), b.alias("b")), share)


def snippet(c: Column, most: int = 220) -> Column:
    """One line of at most ``most`` letters, the last an ellipsis where cut."""
    s = one_line(c)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, most - 1), " +$", ""), F.lit("…")))


def cut(c: Column, most: int = 160) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


# The patterns below decide which texts match, so they must be these.
SECRET = r"(?i)\b((?:api[-_ ]?)?(?:key|token|secret|password)|bearer)\b([ \t\n]*[:=]?[ \t\n]*)([A-Za-z0-9+/_=-]{20,})"
CARD = r"\b(?:[0-9]{4}[- ]?){3}[0-9]{4}\b"
LOGIN = r"(?i)\b([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})([ \t\n]+(?:password|pass|pwd)[ \t\n]+)([^ \t\n]+)"
ACCESS_KEY = r"\bAKIA[0-9A-Z]{16}\b"
INJECTED_LINE = r"(?i)^(system:|###[ \t]*system\b|you are now\b|ignore previous\b)"
INJECTED_BLOCK = r"(?i)<system>.*?</system>|\[INST\].*?\[/INST\]|<\|im_start\|>[ \t]*[^ \t]+[ \t]*|<\|im_end\|>"
INJECTED_MARK = r"(?i)</?system>|<\|im_start\|>|<\|im_end\|>|\[INST\]|\[/INST\]"
INTENTS = (
    ("store", r"(?i)\b(remember|save|note|keep|log|write down|store)\b"),
    ("reflect", r"(?i)\b(reflect|summarize|what have|review|digest|recap)\b"),
    ("recall", r"(?i)\b(recall|what did|do you know|have we|last time|previously)\b"),
    ("workflow", r"(?i)^(how to|how do i|steps to|walk me through|show me how|what's the process)\b|\b(workflow|procedure|runbook|playbook)\b"),
    ("command", r"(?i)^/|^(do|run|execute|create|build|make|generate|fix|update|delete)\b"),
    ("question", r"(?i)\?$|^(what|how|why|when|where|who|is|are|can|could|should|would)\b"),
)


#: The heading of a briefing; a name of one word may follow "Memory".
BRIEFING = r"(?m)^## Memory( [A-Z][a-z]+)? (— )?(Context|Wake) Briefing"


def redacted(c: Column) -> Column:
    """Labelled secrets, card numbers, passwords after e-mail addresses and access keys replaced by [REDACTED]."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), ascii_edges(SECRET), "$1$2[REDACTED]")
    c = F.regexp_replace(c, ascii_edges(CARD), "[REDACTED]")
    c = F.regexp_replace(c, ascii_edges(LOGIN), "$1$2[REDACTED]")
    return F.regexp_replace(c, ascii_edges(ACCESS_KEY), "[REDACTED]")


def sanitised(c: Column, most: int = 2000) -> Column:
    """Without lines and markers that pose as another role's; at most ``most`` letters."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    lines = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, INJECTED_BLOCK, ""), INJECTED_MARK, ""), r"[ \t\r\f]+$", ""))
    lines = F.filter(lines, lambda x: ~F.regexp_like(F.regexp_replace(x, "^[ \t\r\f]+", ""), F.lit(ascii_edges(INJECTED_LINE))) & (trim(x) != ""))
    return trim(F.substring(F.array_join(lines, "\n"), 1, most))


def intent(c: Column) -> Column:
    """The first intent whose words occur."""
    t = trim(c)
    out = F.when(t == "", "general")
    for name, pattern in INTENTS:
        out = out.when(t.rlike(ascii_edges(pattern)), name)
    return out.otherwise("general")


def confidence_label(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), "").when(c >= 0.85, " [HIGH CONFIDENCE]").when(c >= 0.5, "").otherwise(" [low confidence]")


def idea_title(c: Column) -> Column:
    """Letters and digits of a title without articles."""
    c = F.regexp_replace(F.lower(c), "[^a-z0-9 \t\n\r\f]", " ")
    return trim(F.regexp_replace(F.regexp_replace(c, ascii_edges(r"\b(the|a|an)\b"), " "), SPACE + "+", " "))


def skill_name(c: Column, fallback: str = "skill-gap-1") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", fallback).otherwise(s)


def wake_summary(c: Column) -> Column:
    """The last session's summary; of one that repeats a briefing, what follows the first heading that is known."""
    c = trim(c)
    out = c
    for mark in ("Open goals:", "## Recent conversation", "Recent conversation:"):
        at = F.locate(mark, c)
        out = F.when(at > 0, trim(F.substring(c, at, F.length(c)))).otherwise(out)
    return F.when(c.rlike(BRIEFING), out).otherwise(c)


def pair_key(a: Column, b: Column) -> Column:
    a, b = a.cast("string"), b.cast("string")
    return F.concat_ws("::", F.least(a, b), F.greatest(a, b))


def html_escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4)


def sentence_cut(c: Column, most: int) -> Column:
    """At most ``most`` letters, up to the last end of a sentence or paragraph if there is one."""
    end = F.regexp_extract(F.substring(c, 1, most + 1), rf"(?s)^(.{{0,{most - 1}}}[.!?])(?:{SPACE}|$)", 1)
    blank = F.regexp_extract(F.substring(c, 1, most + 1), rf"(?s)^(.{{1,{most}}})\n\n", 1)
    best = F.when(F.length(blank) > F.length(end), blank).otherwise(end)
    return F.when(F.length(c) <= most, c).when(best != "", best).otherwise(F.substring(c, 1, most))


def session_parts(c: Column) -> Column:
    """(provider, scope, target) of ``agent:<id>:<provider>:<scope>:<target>``; null otherwise."""
    p = r"^agent:[^:]+:([^:]+):([^:]+):(.+)$"
    return F.when(c.rlike(p), F.struct(*[F.regexp_extract(c, p, i).alias(n) for i, n in ((1, "provider"), (2, "scope"), (3, "target"))]))


def session_key(session: Column, conversation: Column) -> Column:
    """One key for direct chats, whether the session or the conversation names them."""
    s, c, parts = trim(session), trim(conversation), session_parts(trim(session))
    direct = (parts["provider"] == "telegram") & (parts["scope"] == "direct")
    named = F.startswith(c, F.lit("telegram:")) & ((s == "") | F.coalesce(direct, F.lit(False)))
    return F.when(F.startswith(s, F.lit("telegram:")), s).when(named, c).when(direct, F.concat(F.lit("telegram:"), parts["target"])).when(s != "", s).otherwise(c)


def titled(c: Column) -> Column:
    """Words of a dashed name with a capital first letter; others stay."""
    parts = F.filter(F.split(c, r"[-_ \t\n\r\f]+"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def skill_document(name: Column, description: Column, content: Column) -> Column:
    """A skill text with its heading and the four sections that every skill has."""
    title, said = titled(name), trim(description)
    low = F.lower(title)
    body = F.when(trim(content) == "", said).otherwise(trim(content))
    head = F.concat(F.lit("# "), title)
    marked = r"(?s)^((?:.*?\n)??)#[ \t]+[^\n]*(.*)$"
    body = F.when(body.rlike(r"(?m)^#[ \t]+"), F.concat(F.regexp_extract(body, marked, 1), head, F.regexp_extract(body, marked, 2))).otherwise(F.concat(head, F.lit("\n\n"), body))

    def section(b, pattern, text):
        return F.when(b.rlike(pattern), b).otherwise(F.concat(b, text))

    body = section(body, r"(?i)##[ \t]+(Trigger Conditions|When to Use|Activation)", F.concat(F.lit("\n\n## Trigger Conditions\n- "), F.when(said != "", said).otherwise(F.concat(F.lit("Use when "), low, F.lit(" is needed.")))))
    body = section(body, r"(?i)##[ \t]+(Steps|Procedure|Workflow)", F.concat(F.lit("\n\n## Steps\n1. Review the relevant context for "), low, F.lit(".\n2. Execute the documented process and verify the result.")))
    body = section(body, r"(?i)##[ \t]+Pitfalls", F.lit("\n\n## Pitfalls\n- Do not apply this skill before confirming the trigger conditions match."))
    return trim(section(body, r"(?i)##[ \t]+(Verification|Success Criteria)", F.lit("\n\n## Verification\nConfirm the expected outcome is visible before concluding the task.")))
