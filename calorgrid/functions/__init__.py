"""calorgrid.functions"""
