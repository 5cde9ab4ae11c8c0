"""Workforce analytics as Spark DataFrame jobs.

Layout
------
``plans``      reusable plan shapes (constants, distributed running totals, size-checked choices)
``functions``  column expressions (masking, text, dates, rankings)
``sources``    readers, writers, ingest runs, upsert, saved indexes and models
``operators``  DataFrame in, DataFrame out: features, risk, text, themes, model, retrieval, career
"""

__version__ = "0.1.0"
