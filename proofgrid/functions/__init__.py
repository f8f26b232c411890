"""Part of proofgrid: functions."""
