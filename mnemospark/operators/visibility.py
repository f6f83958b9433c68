"""Which rows a request from a channel may see.

A channel is a bare name or ``name:suffix``.  A peer channel has a numeric suffix,
which names one person: rows of others must not be seen there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions.text import trim

#: The channel of administration, which sees past the peer rules.
MANAGEMENT = "__management__"


def scope(c: Column) -> Column:
    """Trimmed; empty is null."""
    return F.nullif(trim(c), F.lit(""))


def _prefix(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(":")), F.substring_index(c, ":", 1)).otherwise(c)


def _suffix(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(":")), F.regexp_extract(c, "(?s)^[^:]*:(.*)$", 1)).otherwise(F.lit(""))


def agent_of(channel: Column, agent: Column | None = None) -> Column:
    """The agent: named, or what stands before the colon."""
    from_channel = F.nullif(trim(F.substring_index(channel, ":", 1)), F.lit(""))
    return from_channel if agent is None else F.coalesce(scope(agent), from_channel)


def channel_visible(row: Column, request: Column) -> Column:
    """A row of channel ``row`` (null: global) for a request: all without a channel; else by the kind of channel asked from."""
    m, r = scope(row), scope(request)
    peer = _suffix(r).rlike("^[0-9]+$")
    scoped = F.when(m == r, True).when(m.isNull() | peer, False).otherwise((m == _prefix(r)) | (m == _suffix(r)))
    bare = F.when(m.isNull(), True).otherwise(m == r)
    return F.when(r.isNull(), True).when(F.contains(r, F.lit(":")), scoped).otherwise(bare)


def _allowed(agent_ids: Column, agent: Column, if_unnamed: bool) -> Column:
    ids = F.filter(F.transform(F.coalesce(agent_ids, F.array().cast("array<string>")), trim), lambda x: x != "")
    return F.when(F.size(ids) == 0, True).when(scope(agent).isNull(), if_unnamed).otherwise(F.array_contains(ids, scope(agent)))


def base_visible(is_active: Column, agent_ids: Column, kb_scope: Column, policy: Column, agent: Column, channel: Column, peer_prefixes: Sequence[str], strict: bool = True) -> Column:
    """Whether an agent sees a knowledge base.

    Inactive ones are hidden.  Of ``peer_prefixes``, a channel without or with a
    non-numeric suffix needs a permissive base; a numeric one needs, unless the
    base is permissive, a scope that names this peer.  Other channels need an equal
    scope if the base has one.  Last, the list of agents.
    """
    s, c = scope(kb_scope), scope(channel)
    same = s.isNull() | F.coalesce(s == c, F.lit(False))
    if not strict:
        return F.coalesce(is_active & same & _allowed(agent_ids, agent, False), F.lit(False))
    prefix, suffix, has_colon = _prefix(c), _suffix(c), F.coalesce(F.contains(c, F.lit(":")), F.lit(False))
    kind = F.coalesce(policy, F.lit("strict"))
    is_peer = F.coalesce(prefix.isin(*peer_prefixes), F.lit(False)) if peer_prefixes else F.lit(False)
    numeric = has_colon & suffix.rlike("^[0-9]+$")
    names_peer = F.coalesce((s == c) | (s == suffix), F.lit(False))
    by_peer = F.when(numeric, (kind != "strict") | names_peer).otherwise(kind == "permissive")
    by_channel = F.when(~same & ~has_colon, False).when(is_peer, by_peer).otherwise(same)
    seen = F.when(c == MANAGEMENT, _allowed(agent_ids, agent, True)).otherwise(by_channel & _allowed(agent_ids, agent, False))
    return F.coalesce(is_active & seen, F.lit(False))


def chunk_visible(chunk_scope: Column, kb_scope: Column, policy: Column, channel: Column) -> Column:
    """Chunks of a base for a channel: in a peer channel those of this peer, or unscoped ones of a base that is this peer's or shared."""
    peer = F.when(F.contains(channel, F.lit(":")), F.regexp_extract(channel, "(?s)([^:]*)$", 1))
    unscoped = chunk_scope.isNull() | (chunk_scope == "")
    parent = F.coalesce((kb_scope == peer) | (kb_scope == channel), F.lit(False))
    shared = F.coalesce((policy == "permissive") & F.endswith(kb_scope, F.lit(":main")), F.lit(False))
    keep = F.coalesce((chunk_scope == peer) | (chunk_scope == channel), F.lit(False)) | (unscoped & (parent | shared))
    return F.when(peer.isNull(), True).when(peer == "", False).otherwise(keep)


def chunk_admitted(chunk_scope: Column, kb_scope: Column, policy: Column, agent_ids: Column, peer_prefixes: Sequence[str]) -> Column:
    """Unscoped chunks don't enter a strict, unscoped base of peer channels."""
    peers = F.arrays_overlap(agent_ids, F.array(*[F.lit(p) for p in peer_prefixes]))
    return ~(scope(chunk_scope).isNull() & scope(kb_scope).isNull() & (F.coalesce(policy, F.lit("strict")) == "strict") & F.coalesce(peers, F.lit(False)))
