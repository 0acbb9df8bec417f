"""Column builders: detection, redaction, signals, hashing."""
