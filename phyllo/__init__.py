"""phyllo: a Spark-native engine for curating labelled image collections.

The package holds the curation and evaluation operators (``operators``), their
scalar building blocks (``functions``), readers and writers (``sources``),
whole dataflows (``plans``) and incremental variants (``streaming``).
"""

__version__ = "0.1.0"
