"""Every registered query of the retrieval engine, with its SQL where SQL can express it."""

from __future__ import annotations

from folio.plans import retrieval, service, stored, structure

QUERIES = {**structure.QUERIES, **retrieval.QUERIES, **service.QUERIES, **stored.QUERIES}
ORACLES = {**structure.ORACLES, **retrieval.ORACLES, **service.ORACLES, **stored.ORACLES}
