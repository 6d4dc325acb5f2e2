"""Part of the tidewell engine: functions."""
