"""Training-data operators: decontamination, formatting, fingerprints, filters, packing, archives, sharding."""
