"""All registered queries of the engine and their SQL, whatever their module."""

from strandlog.plans import registry, registry_answers, registry_ingest, registry_store

MODULES = (registry, registry_store, registry_answers, registry_ingest)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: x for m in MODULES for k, x in m.ORACLE.items()}
