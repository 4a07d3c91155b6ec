"""Training-data operators: cleaning, deduplication, search, packing, mixing and archives.

Nothing outside this subpackage imports it; ``leafmill.llm.queries`` lists its registered queries.
"""
