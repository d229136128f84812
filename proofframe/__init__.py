"""proofframe: checking data against what is claimed about it, on Spark DataFrames."""
