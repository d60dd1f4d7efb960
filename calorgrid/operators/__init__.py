"""calorgrid.operators"""
