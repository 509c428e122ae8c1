"""ledgerloom: record linkage and screening over filing registers, as Spark plans."""

__version__ = "0.1.0"
