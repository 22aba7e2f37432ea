"""Readers and writers: document batches, vocabularies, snapshots, workloads."""
