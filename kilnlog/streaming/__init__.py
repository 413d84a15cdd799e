"""kilnlog.streaming"""
