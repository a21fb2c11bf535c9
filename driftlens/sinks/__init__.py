"""driftlens.sinks package."""
