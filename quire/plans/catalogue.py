"""All registered queries over the supplied tables."""

from __future__ import annotations

from quire.plans import audits, contracts, corpus, evidence, lexicon, located, runs
from quire.plans.base import Query

QUERIES: dict[str, Query] = {**located.QUERIES, **corpus.QUERIES, **evidence.QUERIES, **audits.QUERIES,
                             **runs.QUERIES, **lexicon.QUERIES, **contracts.QUERIES}
