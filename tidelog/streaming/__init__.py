"""Running change streams."""
