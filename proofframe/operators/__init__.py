"""operators of proofframe."""
