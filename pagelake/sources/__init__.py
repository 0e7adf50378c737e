"""pagelake.sources"""
