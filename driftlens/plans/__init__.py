"""driftlens.plans package."""
