"""Part of the tidewell engine: plans."""
