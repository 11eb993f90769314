"""PySpark-native engine for financial documents and their ledger."""
