"""Sampling, profiling, storage and maintenance of samples."""
