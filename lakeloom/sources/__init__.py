"""lakeloom.sources"""
