"""proofgrid: evidence-grade analytics and hybrid document retrieval as plain PySpark DataFrame functions."""

__version__ = "0.1.0"
