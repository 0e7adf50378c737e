"""pagelake.plans"""
