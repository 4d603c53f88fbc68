"""Writers for batch results and streams."""
