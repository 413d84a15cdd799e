"""kilnlog.functions"""
