"""streaming of proofframe."""
