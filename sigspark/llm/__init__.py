"""Training-data operators: dedup, mixing, packing, scans and classifiers over `documents` and `pages`.

Nothing else in the package imports this subpackage; its queries are in `llm.queries`.
"""
