"""Column expressions: text, offsets, licences, statistics."""
