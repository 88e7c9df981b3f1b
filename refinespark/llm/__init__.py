"""Operations of a training-data pipeline: ten operators, their queries and their SQL twins.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
