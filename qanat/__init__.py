"""A PySpark engine that curates and audits conversation and document corpora."""
