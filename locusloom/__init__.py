"""Genotype merge, polygenic scoring and reporting as Spark DataFrame operators."""

__version__ = "0.1.0"
