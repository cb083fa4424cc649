"""pagelode.sources"""
