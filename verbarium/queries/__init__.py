"""Package queries."""
