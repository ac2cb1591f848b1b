"""lakeloom.operators"""
