"""Readers: plain files by Spark's own line reader, everything else by a streaming data source."""
