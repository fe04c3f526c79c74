"""Block-transform, entropy-coding and rate-distortion analytics on Spark tables."""
