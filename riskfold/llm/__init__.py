"""Training-data operators: ten numbered operators, their queries and the
stages of ``corpus_pipeline.py``. Nothing outside this folder imports it."""
