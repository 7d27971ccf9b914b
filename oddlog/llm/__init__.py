"""Operators for training data. Nothing outside this folder imports it but the driver entry."""
