"""Forecasts, churn, clusters and anomalies."""
