"""loomery: annotated text and machine-extracted records as clean, linked, scored Spark tables."""
