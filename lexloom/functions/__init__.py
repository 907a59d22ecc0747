"""Column functions: text analysis, scoring formulas, vector arithmetic, highlighting."""
