"""Collection storage, importers and table readers."""
