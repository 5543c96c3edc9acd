"""tidewell.operators"""
