"""Place-evidence analytics as DataFrame transformations."""
