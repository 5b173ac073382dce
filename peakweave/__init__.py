"""Spectrum search and general analytics expressed as Spark DataFrame plans."""
