"""Wayloom: street-network and line-conflation analytics as lazy Spark DataFrame transforms."""

__version__ = "0.1.0"
