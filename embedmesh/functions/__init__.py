"""Part of embedmesh; see README.md."""
