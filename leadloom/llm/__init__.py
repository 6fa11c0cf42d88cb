"""Operators for preparing training text at scale.

Each module holds one operator with a general interface; ``queries`` applies
them with production parameters to whole tables.  Nothing outside this
subpackage (and ``corpus_pipeline``) imports it.
"""
