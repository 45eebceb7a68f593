"""widestat.operators"""
