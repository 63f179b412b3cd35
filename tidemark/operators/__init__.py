"""DataFrame → DataFrame operators of the engine."""
