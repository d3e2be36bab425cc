"""Training-data operators: dedup, decontamination, filters, fingerprints, packing."""
