"""Training-data operators: cleaning, de-duplication, scanning, scoring and packing of text corpora."""
