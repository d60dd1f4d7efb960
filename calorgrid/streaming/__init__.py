"""calorgrid.streaming"""
