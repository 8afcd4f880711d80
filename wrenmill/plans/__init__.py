"""Query registry and multi-stage plans."""
