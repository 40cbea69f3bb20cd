"""Models rebuilt as set-based algebra or on MLlib."""
