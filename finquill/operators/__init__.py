"""finquill.operators"""
