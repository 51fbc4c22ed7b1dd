"""Part of parley; see README.md."""
