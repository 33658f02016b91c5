"""Data quality, cleaning and anomaly detection as lazy DataFrame operators."""
