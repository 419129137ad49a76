"""Training-data operators: quality, near-duplicates, packing, decontamination, tokens, HTML, WARC."""
