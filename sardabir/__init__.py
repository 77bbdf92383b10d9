"""Sardabir: a PySpark engine that proofreads large Persian text corpora."""

__version__ = "0.1.0"
