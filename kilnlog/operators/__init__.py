"""kilnlog.operators"""
