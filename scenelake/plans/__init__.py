"""Views of the star-schema tables as scenes, classes, types, rooms and points."""
