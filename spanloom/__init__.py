"""Spanloom: locate, align and score corpus spans in transcripts, on Spark."""
