"""calorgrid.plans"""
