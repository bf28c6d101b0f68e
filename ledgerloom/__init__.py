"""ledgerloom: provenance and evaluation analytics over run ledgers, as Spark DataFrame operators."""

__version__ = "0.1.0"
