"""linkspark.sources"""
