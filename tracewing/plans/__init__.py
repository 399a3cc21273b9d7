"""The flows a user calls, composed from the operators."""
