"""linkspark.streaming"""
