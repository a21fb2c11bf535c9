"""driftlens.streaming package."""
