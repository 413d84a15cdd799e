"""kilnlog.plans"""
