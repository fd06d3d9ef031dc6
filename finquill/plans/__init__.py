"""finquill.plans"""
