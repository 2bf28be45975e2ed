"""Session helpers, size checks and end-to-end data flows."""
