"""Part of the tidewell engine: operators."""
