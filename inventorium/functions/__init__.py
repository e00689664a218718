"""Column functions over names, paths, titles and texts."""
