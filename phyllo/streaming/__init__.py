"""Incremental variants of the curation operators; an addition to the reference's operators."""
