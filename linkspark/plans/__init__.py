"""linkspark.plans"""
