"""linkspark.functions"""
