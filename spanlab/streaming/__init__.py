"""Incremental runs: what was done before is left out, new rows are appended."""
