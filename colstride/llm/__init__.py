"""Operations of a training-data pipeline: dedup, filtering, tokenising, packing and mixing.

Nothing outside this folder imports it, apart from the top-level ``corpus_pipeline.py`` and the
guarded registration in ``__spark_entry__.py``.
"""
