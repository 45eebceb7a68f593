"""widestat.sources"""
