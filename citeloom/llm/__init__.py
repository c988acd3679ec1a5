"""Corpus-preparation operators: tokens, fingerprints, mixing, dedup, scoring, archives."""
