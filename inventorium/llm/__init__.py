"""Operators for preparing text corpora: decontamination, sharding, counting, cleaning, searching and packing."""
