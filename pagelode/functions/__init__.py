"""pagelode.functions"""
