"""Registered queries: the operators over the logical tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from mnemospark.plans import aggregates, filters, jobs, joins, lifecycle, recall, scalars, scans, sessions, windows  # noqa: F401
from mnemospark.plans.recall import flagship  # noqa: F401
