"""lakeloom.streaming"""
