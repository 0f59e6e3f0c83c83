"""Named queries of the core."""

from __future__ import annotations

from tidemark.catalog import Catalog


def core() -> Catalog:
    from tidemark.plans import lookups, streams, study, temporal, texts

    full = Catalog()
    for part in (temporal, lookups, study, texts, streams):
        full.include(part.catalog)
    return full
