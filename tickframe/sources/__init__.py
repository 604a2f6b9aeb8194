"""Where bars come from: canonical columns, readers, and bars built from ticks."""
