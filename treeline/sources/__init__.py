"""Readers and writers: control files of relations and statistics, Parquet tables bound to atoms, plan files."""
