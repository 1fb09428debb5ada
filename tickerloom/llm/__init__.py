"""Training-data operators. Nothing outside this subpackage imports it, but for the entry point's guarded import."""
