"""sparrowlake.sources"""
