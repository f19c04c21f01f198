"""Quire: ledger, integrity and evaluation analytics as lazy PySpark DataFrame operators."""
