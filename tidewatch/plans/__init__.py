"""Whole jobs: ingest, investigation, behaviour, backtest."""
