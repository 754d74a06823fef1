"""Column functions: checksums, number spellings, text escapes, regex helpers."""
