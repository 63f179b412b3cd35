"""Forecasters: a JVM-only baseline and a linear direct model per horizon."""
