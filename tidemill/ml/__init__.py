"""Models trained here: segments, Poisson forecasts."""
