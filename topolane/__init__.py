"""topolane: code-topology and session-ledger analytics as plain Spark DataFrames."""

INDEX_VERSION = 4
LEDGER_VERSION = 1

__all__ = ["INDEX_VERSION", "LEDGER_VERSION"]
