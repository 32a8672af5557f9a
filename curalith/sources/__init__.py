"""Readers and writers: CSV cells, reference data, quality models, the run store, outputs."""
