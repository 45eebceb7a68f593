"""widestat.functions"""
