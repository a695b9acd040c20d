"""Operators for preparing text corpora on Spark. Nothing outside this subpackage imports it."""
