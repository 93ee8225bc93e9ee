"""User-facing jobs composed from the operators."""
