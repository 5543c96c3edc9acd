"""tidewell.streaming"""
