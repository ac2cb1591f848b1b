"""lakeloom.functions"""
