"""Readers and writers: driver tables, raw CSV, document collections."""
