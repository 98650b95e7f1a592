"""Column expressions: checksums, validators, masks, escapes."""
