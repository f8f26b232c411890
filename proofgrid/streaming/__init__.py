"""Part of proofgrid: streaming."""
