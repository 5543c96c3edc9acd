"""tidewell.functions"""
