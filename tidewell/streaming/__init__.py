"""Part of the tidewell engine: streaming."""
