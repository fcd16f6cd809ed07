"""Results as files."""
