"""Fernweave: tables from many sources joined, unified, checked and versioned with Spark."""
