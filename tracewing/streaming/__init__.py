"""The incremental form of the append that scheduled runs make."""
