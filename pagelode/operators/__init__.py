"""pagelode.operators"""
