"""Calibrated forecasting on entity x time panels, expressed as Spark jobs."""
