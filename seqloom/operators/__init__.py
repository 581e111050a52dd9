"""Operators over records: ranges, combinations, aggregates, processors, sinks."""
