"""Sinks: JSON lines, CSV, summaries, tees, and retention of checkpoints."""
