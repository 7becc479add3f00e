"""Training-data operators and their registered queries.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds
``llm.queries.QUERIES`` and ``llm.queries.ORACLES`` when it can be imported.
"""
