"""Part of quern; see README.md for the map of the package."""
