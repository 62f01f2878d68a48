"""Training-data operators: URL lists, personal data, token counts, fingerprints,
chat formatting, near-duplicates, quality bands, packing, mixing and sharding."""
