"""pagelode.plans"""
