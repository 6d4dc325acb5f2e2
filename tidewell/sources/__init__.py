"""Part of the tidewell engine: sources."""
