"""Training-data operators over a `documents` table.

Each module holds one operator; `queries` holds the thin registered queries.
Nothing outside this subpackage (and `corpus_pipeline.py`) imports it.
"""
