"""Sources: seed lists, page snapshots and page streams."""
