"""Catalog ingestion and analytics as Spark jobs.

Every public operator is ``f(df, ...) -> DataFrame``; the per-row part of each is
a Catalyst column expression from :mod:`larder.functions`.
"""
