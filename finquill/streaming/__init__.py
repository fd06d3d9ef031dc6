"""finquill.streaming"""
