"""The title chain and the routine over file streams."""
