"""Column functions: candles, guarded arithmetic, indicator formulas, prices."""
