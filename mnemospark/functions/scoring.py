"""Ranking, salience, decay and spend scores as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.timeexpr import age_days, decayed

# Weights, bonuses and presets decide the ranking, so they must be these.
WEIGHTS = {"vector": 0.30, "strength": 0.22, "freshness": 0.15, "access": 0.06, "salience": 0.14, "continuity": 0.08, "text": 0.12, "kb": 0.25}
CATEGORY_BONUS = {"decision": 0.2, "lesson": 0.18, "goal": 0.15, "skill": 0.14, "person": 0.12, "rule": 0.12, "workflow": 0.1, "fact": 0.08, "event": 0.05, "conversation": 0.0}
STORE_BONUS = {"semantic": 0.15, "procedural": 0.12, "prospective": 0.1, "episodic": 0.08, "sensory": 0.0}
DECISION = "decided|decision|chose|agreed|confirmed|going with"
LESSON = "learned|lesson|mistake|should have|next time|always|never|pattern"
GOAL = "goal|target|milestone|deadline|must|need to|plan to|will build"
FRESHNESS_K, ACCESS_K, EXPANSION_K, PRESSURE_K = 0.12, 0.08, 0.10, 0.05
LEAST_SCORE = 0.25


@dataclass(frozen=True)
class Mode:
    """A preset of recall: which rows, how many, and weights that differ from the default ones."""

    limit: int = 8
    stores: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    weights: Mapping[str, float] = field(default_factory=dict)


MODES = {
    "general": Mode(),
    "decision": Mode(12, ("semantic", "episodic"), ("decision", "lesson", "rule"), {"strength": 0.34, "freshness": 0.12, "vector": 0.33, "salience": 0.16, "text": 0.14, "kb": 0.26}),
    "project": Mode(12, ("semantic", "episodic", "procedural"), ("goal", "workflow", "skill", "decision", "fact"), {"strength": 0.26, "freshness": 0.24, "vector": 0.26, "salience": 0.14, "continuity": 0.1, "text": 0.14, "kb": 0.26}),
    "people": Mode(8, ("semantic", "episodic"), ("person", "decision", "event"), {"strength": 0.32, "freshness": 0.1, "vector": 0.36, "salience": 0.14, "text": 0.16, "kb": 0.26}),
    "workflow": Mode(10, ("procedural", "semantic"), ("workflow", "skill", "rule", "lesson"), {"strength": 0.22, "freshness": 0.18, "vector": 0.34, "salience": 0.14, "text": 0.2, "kb": 0.26}),
    "conversation": Mode(6, ("sensory", "episodic"), ("conversation", "event"), {"strength": 0.18, "freshness": 0.28, "vector": 0.26, "salience": 0.1, "continuity": 0.12, "text": 0.16, "kb": 0.18}),
}


def clamp01(c: Column) -> Column:
    """From 0 to 1; what isn't a finite number is 0."""
    c = c.cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def lookup(table: Mapping[str, float], key: Column, default: float = 0.0) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


#: As many words as the bonus for length counts (0.15 x 200).
MOST_WORDS = 30
NAME = r"(?<![A-Za-z0-9_])[A-Z][a-z]++(?![A-Za-z0-9_])"


def salience(counted: Column, matched: Column, content: Column, category: Column, store: Column, tags: Column) -> Column:
    """A prior for how much a row matters: its length, tell-tale words, kind, names and tags."""
    n = T.words_up_to(counted, MOST_WORDS)
    low = F.lower(matched)
    # The words are plain texts: looking for each in turn is cheaper than one pattern of all.
    bonus = lambda p, v: F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in p.split("|")]), v).otherwise(0.0)
    # Two names earn all that names can.
    names = F.when(content.rlike(f"(?s){NAME}.*?{NAME}"), 2).when(content.rlike(NAME), 1).otherwise(0)
    total = 0.3 + F.least(n / 200, F.lit(0.15)) + bonus(DECISION, 0.15) + bonus(LESSON, 0.12) + bonus(GOAL, 0.12)
    total = total + lookup(CATEGORY_BONUS, category) + lookup(STORE_BONUS, store) + F.least(names / 20, F.lit(0.08)) + F.least(F.size(tags) * 0.02, F.lit(0.08))
    return clamp01(total)


def stored_salience(title: Column, content: Column, category: Column, store: Column, tags: Column) -> Column:
    """As computed when a row is written: words of the content alone."""
    body = T.trim(content)
    return salience(body, F.concat_ws(" ", title, body), body, category, store, tags)


def estimated_salience(title: Column, content: Column, category: Column, store: Column, tags: Column) -> Column:
    """As estimated while ranking: words of title and content."""
    both = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))
    return salience(both, both, content, category, store, tags)


def access_signal(count: Column, last_accessed: Column, now_ms: int) -> Column:
    return clamp01(clamp01(F.coalesce(count, F.lit(0)) / 20) * 0.55 + decayed(age_days(now_ms, last_accessed), ACCESS_K) * 0.45)


def signals(now_ms: int, vector: Column, text: Column, channel: str | None = None) -> dict[str, Column]:
    """The eight signals of a memory row, each from 0 to 1."""
    wanted = (channel or "").strip().lower()
    created = F.coalesce("created_ms", F.lit(now_ms))
    return {
        "vector": clamp01(vector),
        "strength": clamp01(F.col("strength")),
        "freshness": clamp01(decayed(age_days(now_ms, created), FRESHNESS_K)),
        "access": access_signal(F.col("access_count"), F.coalesce(F.col("last_accessed_ms"), created), now_ms),
        "salience": clamp01(F.coalesce(F.col("salience"), estimated_salience(F.col("title"), F.col("content"), F.col("category"), F.col("store"), F.col("tags")))),
        "continuity": (T.folded(F.col("channel")) == wanted).cast("double") if wanted else F.lit(0.0),
        "text": clamp01(text),
        "kb": F.col("kb_id").isNotNull().cast("double"),
    }


def recall_score(found: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    w = {**WEIGHTS, **(weights or {})}
    out = None
    for k in WEIGHTS:
        term = found[k] * F.lit(w[k])
        out = term if out is None else out + term
    return out


def observation_count(metadata: Column) -> Column:
    """The number under observationCount; null where it is missing or a string."""
    raw = F.get_json_object(metadata, "$.observationCount")
    return F.when(metadata.rlike(r'"observationCount"[ \t\n]*:[ \t\n]*-?[0-9]'), raw.cast("double"))


def procedural_factor(category: Column, metadata: Column) -> Column:
    """Half for workflows seen less than three times."""
    return F.when((category == "workflow") & (observation_count(metadata) < 3), 0.5).otherwise(1.0)


def linear_decay(strength: Column, days: Column, access_count: Column, valence: Column, arousal: Column) -> Column:
    strong = (F.abs(valence) > 0.7) & (arousal > 0.7)
    rate = F.greatest(F.lit(0.005), F.when(strong, 0.01).otherwise(0.02) - F.least(access_count * 0.002, F.lit(0.01)))
    return clamp01(strength - rate * days)


def retention_score(strength: Column, days: Column) -> Column:
    """What goes first under pressure has the least of it."""
    return strength * 0.4 + decayed(days, PRESSURE_K) * 0.6


def cluster_confidence(size: Column, similarity: Column, least: int = 3) -> Column:
    return F.greatest(F.lit(0.55), F.least(F.lit(0.95), 0.55 + (size - least) * 0.08 + (similarity - 0.75) * 0.5))


def spend(input_tokens: Column, output_tokens: Column, input_rate: float = 0.1, output_rate: float = 0.9) -> Column:
    """US dollars at rates for a million tokens, to six places."""
    return F.round(input_tokens / 1_000_000 * input_rate + output_tokens / 1_000_000 * output_rate, 6)


def injection_budget(effective_tokens: Column, share: Column, ceiling: int = 8000) -> Column:
    return F.least(F.floor(effective_tokens * share) * 4, F.lit(ceiling))


def summary_target(tokens: Column, mode: str, condensed: int = 900) -> Column:
    if mode == "condensed":
        return F.lit(max(512, condensed)).cast("long")
    low, high, part = (96, 640, 0.2) if mode == "aggressive" else (192, 1200, 0.35)
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(tokens * part))).cast("long")


def bounded_weights(weights: Mapping[str, float], low: float = 0.02, high: float = 0.5) -> dict[str, float]:
    """Weights scaled to a sum of 1 inside [low, high]; one that leaves the bounds is held there and the others share the rest.

    Eight numbers, so this is plain Python; what rounding leaves goes to the first.
    """
    out, free, left = {k: max(v, 0.0) for k, v in weights.items()}, list(weights), 1.0
    while free:
        total = sum(out[k] for k in free)
        wanted = {k: (out[k] / total if total else 1 / len(free)) * left for k in free}
        outside = next((k for k in free if not low <= wanted[k] <= high), None)
        if outside is None:
            out.update(wanted)
            break
        out[outside] = low if wanted[outside] < low else high
        left -= out[outside]
        free.remove(outside)
    out = {k: min(high, max(low, v)) for k, v in out.items()}
    first = next(iter(out))
    out[first] = min(high, max(low, out[first] + 1 - sum(out.values())))
    return out


def promoted(baseline: float, candidate: float) -> bool:
    """Whether a policy replaces another: better by more than a twentieth."""
    return candidate > baseline and candidate > (0.05 if baseline <= 0 else baseline * 1.05)
