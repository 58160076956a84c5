"""All queries outside the optional subpackage, by name."""

from kernmill.plans import corpus, graph, markup, markup_cases, stages, structure, text_cases

FLAGSHIP = "merged_entities"

_MODULES = (graph, corpus, markup, markup_cases, stages, structure, text_cases)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
