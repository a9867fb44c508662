"""linkspark.operators"""
