"""The same checks on streams."""
