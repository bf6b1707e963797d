"""Operators of a training-data pipeline: dedup, decontamination, filtering, packing, formatting, scoring.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it. ``queries.py`` holds the
registered queries; every operator module has its own general interface.
"""
