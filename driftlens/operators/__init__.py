"""driftlens.operators package."""
