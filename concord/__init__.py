"""Concord: compares what a system declares with what it is observed to do, on Spark."""
