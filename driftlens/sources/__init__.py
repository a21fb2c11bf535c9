"""driftlens.sources package."""
