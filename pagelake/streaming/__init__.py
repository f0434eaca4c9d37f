"""Pages as they arrive."""
