"""functions of proofframe."""
