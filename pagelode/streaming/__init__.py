"""pagelode.streaming"""
