"""kilnlog.sources"""
