"""Sources of change events: file trees, snapshots and their differences, paged feeds, parsers."""
