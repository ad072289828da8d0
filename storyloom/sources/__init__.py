"""Views over landed tables, page extraction, sinks."""
