"""Column expressions over sequences, qualities and coordinates."""
