"""sources of proofframe."""
