"""Wayfold: customer, address, knowledge and telemetry analytics on Spark."""
