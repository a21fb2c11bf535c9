"""driftlens.functions package."""
