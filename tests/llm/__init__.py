"""A package, so that this folder's conftest does not take the name of the one above it."""
