"""Operators for preparing training data from text corpora.

One module per operator; ``queries.py`` registers one query for each. Nothing
outside this subpackage imports it, apart from the guarded import in
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
