"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it. ``queries`` registers one query
per operator; ``corpus_pipeline.py`` at the repository top chains five of
them into a pipeline.
"""
