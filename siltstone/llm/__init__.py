"""Operators for preparing training text: quality, search, truncation, splitting, fusion, packing, overlap."""
