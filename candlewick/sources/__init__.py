"""Sources of bars, minutes and universes."""
