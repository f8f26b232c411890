"""Part of proofgrid: sinks."""
