"""Batch production of digital-product catalogs as Spark DataFrame jobs."""
