"""Training-data operators: deduplication, decontamination, extraction, filtering, mixing and packing of text corpora."""
