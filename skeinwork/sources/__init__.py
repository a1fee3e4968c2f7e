"""Readers and writers: tables, snapshots, feeds, logs."""
