"""Data operators: staging, cleaning, profiling, dimensions, fact, audits, scale helpers."""
