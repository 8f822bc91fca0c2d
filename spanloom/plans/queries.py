"""All queries over the tables of a folder by name, and their SQL."""

from __future__ import annotations

from spanloom.plans import mentions, prompts, reports, retrieval, sessions, transcripts, waste

QUERIES = retrieval.QUERIES | sessions.QUERIES | reports.QUERIES | transcripts.QUERIES | waste.QUERIES | mentions.QUERIES | prompts.QUERIES
SQL = retrieval.SQL | sessions.SQL | reports.SQL | transcripts.SQL | waste.SQL | mentions.SQL | prompts.SQL
