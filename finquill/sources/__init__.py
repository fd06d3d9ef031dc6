"""finquill.sources"""
