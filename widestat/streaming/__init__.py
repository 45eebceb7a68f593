"""widestat.streaming"""
