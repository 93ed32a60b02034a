"""Reserved. All sources of this engine are bounded, so no streaming operator is defined."""
