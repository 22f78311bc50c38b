"""Part of the inkstone document engine."""
