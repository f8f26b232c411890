"""Part of proofgrid: sources."""
