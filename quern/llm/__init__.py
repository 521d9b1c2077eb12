"""Operators for large text corpora: one module an operator, thin queries in ``queries``."""
