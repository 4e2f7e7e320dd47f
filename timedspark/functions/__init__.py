"""Column functions: text, geometry, time formats and reply extraction."""
