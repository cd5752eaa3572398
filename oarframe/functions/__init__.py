"""See the package docstring; each module documents its own operators."""
