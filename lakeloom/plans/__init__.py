"""lakeloom.plans"""
