"""All registered queries: name -> (Spark callable, SQL twin or None)."""
from checks import model_queries, prepare_queries, triage_queries

REGISTRY = {}
for _module in (prepare_queries, triage_queries, model_queries):
    for _name, _pair in _module.QUERIES.items():
        if _name in REGISTRY:
            raise ValueError(f"query {_name!r} is registered twice")
        REGISTRY[_name] = _pair
