"""Spatio-temporal prospectivity analytics expressed as PySpark DataFrame operators."""
