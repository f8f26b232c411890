"""Part of proofgrid: operators."""
