"""Column functions: labels, clocks and signal levels."""
