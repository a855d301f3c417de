"""All queries of the engine and their SQL equivalents."""

from citeloom.plans import answering, reference, reviewing, training

MODULES = (reference, reviewing, answering, training)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = reference.numbering_seed_uncited
