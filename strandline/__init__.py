"""Molecular-profile analytics as ordinary Spark DataFrame operators."""
