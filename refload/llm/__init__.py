"""Operators for building a training corpus: de-duplication, extraction, quality, mixing, packing, counting."""
