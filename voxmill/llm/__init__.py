"""Training-data operators: quality, deduplication, tokenisation, packing and archives. Nothing else in voxmill imports this."""
