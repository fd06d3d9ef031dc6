"""finquill.functions"""
