"""Readers, sinks, the table catalogue, and the catalogue derived from the order tables."""
