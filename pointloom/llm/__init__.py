"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage; removing it (together
with ``corpus_pipeline.py`` and ``tests/llm``) leaves a working library.
"""
