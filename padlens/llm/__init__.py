"""Training-data operators over document and page tables."""
