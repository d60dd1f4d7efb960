"""calorgrid.sources"""
