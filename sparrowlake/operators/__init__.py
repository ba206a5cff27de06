"""sparrowlake.operators"""
