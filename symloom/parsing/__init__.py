"""Source text to symbols, imports and call references, without a grammar library."""
